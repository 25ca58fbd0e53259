"""labelframe.sources"""
