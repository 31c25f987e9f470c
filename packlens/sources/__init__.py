"""packlens.sources"""
