"""fumble.functions"""
