"""topicwatch.operators"""
