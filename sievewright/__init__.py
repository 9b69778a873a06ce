"""Sievewright: corpus curation and score analytics as Spark plans."""
