"""packlens.streaming"""
