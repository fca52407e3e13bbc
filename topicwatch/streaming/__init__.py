"""topicwatch.streaming"""
