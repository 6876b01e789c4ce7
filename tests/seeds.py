"""Dimension rows of the tests."""

from wardline.sources import tables

SUPERVISORS = [
    ("SUP001", "Ilse Varga", "ilse.varga@example.com", "1234", ["HR_Admin", "Medical_Lead"]),
    ("SUP002", "Tomas Okoro", "tomas.okoro@example.com", "5678", ["Finance_Lead"]),
    ("SUP003", "Nadia Brandt", "nadia.brandt@example.com", "9999",
     ["HR_Admin", "Medical_Lead", "Finance_Lead", "General_Staff"]),
]
MANAGERS = [("MGR001", "Pavel Lindqvist", "duty.manager@example.com", True)]


def seed_dims(spark, manager_email=""):
    return tables.seed_dims(spark, SUPERVISORS, MANAGERS, manager_email)
