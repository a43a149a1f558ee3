"""chargeload.sinks"""
