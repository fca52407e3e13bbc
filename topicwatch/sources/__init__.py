"""topicwatch.sources"""
