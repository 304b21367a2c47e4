"""folioframe.plans"""
