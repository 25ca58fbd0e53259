"""labelframe.streaming"""
