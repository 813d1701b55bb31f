"""fumble.streaming"""
