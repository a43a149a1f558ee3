"""chargeload.streaming"""
