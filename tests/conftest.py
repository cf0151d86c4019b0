from __future__ import annotations

import os

import pytest

from plumbline.operators.lookups import References
from plumbline.session import get_session

ISO = [
    (0, "US", "USA", "840", "United States", "Americas", "Northern America"),
    (1, "CA", "CAN", "124", "Canada", "Americas", "Northern America"),
    (2, "MX", "MEX", "484", "Mexico", "Americas", "Latin America"),
    (3, "FR", "FRA", "250", "France", "Europe", "Western Europe"),
    (4, "NA", "NAM", "516", "Namibia", "Africa", "Southern Africa"),
    (5, "AU", "AUS", "036", "Australia", "Oceania", "Australia"),
    (6, "FR", "FXX", "249", "Second France", "Europe", "Western Europe"),
]
BACKBONE = [
    (0, "Animalia", "Chordata", "Mammalia", "Primates", "Hominidae", "Homo", "Homo sapiens", "Linnaeus, 1758"),
    (1, "Animalia", "Chordata", "Mammalia", "Carnivora", "Canidae", "Canis", "Canis lupus", "Linnaeus, 1758"),
    (2, "Animalia", "Chordata", "Mammalia", "Carnivora", "Ursidae", "Ursus", "Ursus americanus", "Pallas, 1780"),
    (3, "Animalia", "Chordata", "Mammalia", "Carnivora", "Ursidae", "Ursus", "Ursus arctos", "Linnaeus, 1758"),
    (4, "Plantae", "Tracheophyta", None, "Rosales", "Rosaceae", "Rubus", "Rubus idaeus", ""),
]
HABITAT = [("Homo sapiens", "terrestrial"), ("Felis catus", "terrestrial"), ("Delphinus delphis", "marine")]


def _box(x1, y1, x2, y2):
    return [(float(a), float(b)) for a, b in [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]


BOUNDARIES = [
    (0, 0, "US", "United States", [_box(-125, 25, -67, 49)]),
    (1, 0, "CA", "Canada", [_box(-141, 49, -52, 70)]),
    (2, 0, "MX", "Mexico", [_box(-117, 14.5, -86.5, 25)]),
    (3, 0, "FR", "France", [_box(-5, 42, 8, 51)]),
    (4, 0, "AU", "Australia", [_box(113, -44, 154, -10)]),
    # a concave shape, a shape with a hole and one of two parts
    (5, 0, "L1", "Concave", [[(20.0, 0.0), (26.0, 0.0), (26.0, 6.0), (23.0, 6.0), (23.0, 3.0), (20.0, 3.0), (20.0, 0.0)]]),
    (6, 0, "H1", "Holed", [_box(30, 0, 36, 6), _box(32, 2, 34, 4)]),
    (7, 0, "M1", "Two parts", [_box(40, 0, 41, 1)]),
    (7, 1, "M1", "Two parts", [_box(44, 0, 45, 1)]),
]
BOUNDARY_DDL = "poly_id int, part int, iso_a2 string, name string, rings array<array<struct<lon:double,lat:double>>>"


@pytest.fixture(scope="session")
def spark():
    session = get_session("plumbline-tests", os.environ.get("PLUMBLINE_TEST_CORES", "8"), shuffle_partitions=4, driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def refs(spark):
    return References(
        iso=spark.createDataFrame(ISO, "pos int, alpha2 string, alpha3 string, numeric string, name string, region string, sub_region string"),
        backbone=spark.createDataFrame(BACKBONE, "pos int, kingdom string, phylum string, clazz string, `order` string, "
                                                 "family string, genus string, canonical_name string, authorship string"),
        habitat=spark.createDataFrame(HABITAT, "name string, habitat string"),
        boundaries=spark.createDataFrame(BOUNDARIES, BOUNDARY_DDL),
    )


@pytest.fixture(scope="session")
def occurrences(spark):
    rows = [
        ("occ1", "2023-01-01", "United States", "US", "37.7749", "-122.4194", "Homo sapiens", "HumanObservation"),
        ("occ2", "2023-01-02", "Canada", "CA", "43.6532", "-79.3832", "Canis lupus", "HumanObservation"),
        ("occ3", "2023-01-03", "Mexico", "MX", "19.4326", "-99.1332", "Felis catus", "HumanObservation"),
        ("occ4", "2023-01-04", "France", "FR", "48.8566", "2.3522", "Ursus americanus", "HumanObservation"),
        ("occ5", "2023-01-05", "BadCountry", "ZZ", "91.0", "181.0", "InvalidName", "BadBasis"),
    ]
    names = ["occurrenceID", "eventDate", "country", "countryCode", "decimalLatitude", "decimalLongitude", "scientificName", "basisOfRecord"]
    return spark.createDataFrame(rows, ", ".join(f"`dwc:{n}` string" for n in names))
