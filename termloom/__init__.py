"""termloom"""
