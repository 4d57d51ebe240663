"""Suppliers and parts, boats and crews."""

from tuplewise.relation import Relation


def suppliers(spark):
    return Relation.table(spark, {"S#": "string", "SNAME": "string", "STATUS": "int", "CITY": "string"}, ("S1", "Smith", 20, "London"), ("S2", "Jones", 10, "Paris"), ("S3", "Blake", 30, "Paris"), ("S4", "Clark", 20, "London"), ("S5", "Adams", 30, "Athens"))


def parts(spark):
    heading = {"P#": "string", "PNAME": "string", "COLOR": "string", "WEIGHT": "double", "CITY": "string"}
    rows = [("P1", "Nut", "Red", 12.0, "London"), ("P2", "Bolt", "Green", 17.0, "Paris"), ("P3", "Screw", "Blue", 17.0, "Oslo"), ("P4", "Screw", "Red", 14.0, "London"), ("P5", "Cam", "Blue", 12.0, "Paris"), ("P6", "Cog", "Red", 19.0, "London")]
    return Relation.table(spark, heading, *rows)


def shipments(spark):
    text = "S1 P1 300|S1 P2 200|S1 P3 400|S1 P4 200|S1 P5 100|S1 P6 100|S2 P1 300|S2 P2 400|S3 P2 200|S4 P2 200|S4 P4 300|S4 P5 400"
    rows = [(a, b, int(c)) for a, b, c in map(str.split, text.split("|"))]
    return Relation.table(spark, {"S#": "string", "P#": "string", "QTY": "int"}, *rows)


def boats(spark):
    return Relation.table(spark, {"Boat": "string", "Rig": "string"}, ("Tern", "sloop"), ("Puffin", "ketch"), ("Gannet", "cutter"), ("Auk", "yawl"), ("Petrel", "lugger"))


def crews(spark):
    rows = [("Ines", "Tern", "1998"), ("Olaf", "Tern", "1998"), ("Ines", "Puffin", "2004"), ("Bao", "Gannet", "2011"), ("Noor", "Auk", "1998")]
    return Relation.table(spark, {"Sailor": "string", "Boat": "string", "Since": "string"}, *rows)
