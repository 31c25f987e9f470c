"""packlens.plans"""
