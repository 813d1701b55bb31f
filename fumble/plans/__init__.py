"""fumble.plans"""
