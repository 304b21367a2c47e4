"""folioframe.streaming"""
