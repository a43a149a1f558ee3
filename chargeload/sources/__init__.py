"""chargeload.sources"""
