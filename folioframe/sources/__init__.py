"""folioframe.sources"""
