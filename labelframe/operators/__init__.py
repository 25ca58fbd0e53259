"""labelframe.operators"""
