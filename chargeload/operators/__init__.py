"""chargeload.operators"""
