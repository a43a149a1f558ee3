"""chargeload.plans"""
