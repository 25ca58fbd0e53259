"""labelframe.functions"""
