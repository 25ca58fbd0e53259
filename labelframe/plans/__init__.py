"""labelframe.plans"""
