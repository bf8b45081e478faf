"""sparkloom.functions"""
