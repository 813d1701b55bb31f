"""fumble.operators"""
