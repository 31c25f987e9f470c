"""packlens.operators"""
