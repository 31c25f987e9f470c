"""packlens.functions"""
