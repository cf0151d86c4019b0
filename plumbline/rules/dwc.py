"""Rule pack for Darwin Core tables.

Every rule reads text and answers a response struct. Where a rule's name left its behaviour open, the
choice made here is stated in the rule's docstring. Blank input means the test cannot be run, except
for the ``*_NOTEMPTY`` tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.coords import dms_to_decimal, metres, number, plain_number
from plumbline.functions.dates import (
    ambiguous_date, duration_days, has_leap_day, iso_interval, standard_date,
)
from plumbline.functions.text import blank, let, strip
from plumbline.rules import base as B
from plumbline.rules.registry import Inputs, Registry

REGISTRY = Registry()
rule = REGISTRY.rule

LAT, LON = "dwc:decimalLatitude", "dwc:decimalLongitude"
CODE, COUNTRY = "dwc:countryCode", "dwc:country"
DATE, BASIS, NAME, RANK = "dwc:eventDate", "dwc:basisOfRecord", "dwc:scientificName", "dwc:taxonRank"
OCCURRENCE = "dwc:occurrenceID"

# Basis-of-record terms.
BASIS_TERMS = [
    "MaterialEntity", "PreservedSpecimen", "FossilSpecimen", "LivingSpecimen", "MaterialSample", "Event",
    "HumanObservation", "MachineObservation", "Taxon", "Occurrence", "MaterialCitation",
]
# Taxon ranks.
RANK_TERMS = [
    "domain", "kingdom", "subkingdom", "phylum", "subphylum", "class", "subclass", "order", "suborder",
    "superfamily", "family", "subfamily", "tribe", "subtribe", "genus", "subgenus", "section", "series",
    "species", "subspecies", "variety", "subvariety", "form", "subform", "cultivar",
]
# Abbreviations and variants of taxon ranks.
RANK_SYNONYMS = {
    "sp": "species", "spp": "species", "spec": "species", "ssp": "subspecies", "subsp": "subspecies",
    "var": "variety", "varietas": "variety", "f": "form", "fo": "form", "forma": "form", "gen": "genus",
    "fam": "family", "ord": "order", "cl": "class", "cv": "cultivar", "subgen": "subgenus", "phyl": "phylum",
}
# Open licence addresses and their usual short texts.
LICENSE_PATTERN = (
    r"(?i)^(https?://creativecommons\.org/(publicdomain/zero/1\.0|licenses/by(-nc)?(-sa|-nd)?/[1-4]\.0)"
    r"(/legalcode|/deed\.[a-z]+)?/?|CC0([ _-]1\.0)?|CC[ _-]BY([ _-]NC)?([ _-](SA|ND))?([ _-][1-4]\.0)?)$"
)

LOCATION, EVENT, TAXON, OCC, RECORD = (
    "dcterms:Location", "dwc:Event", "dwc:Taxon", "dwc:Occurrence", "dwc:Record-level")
SPACE, MANAGE, TAXA, ALIEN, BIOTIC = (
    "Spatial-Temporal_Patterns", "Record-Management", "Taxon-Management", "Alien-Species", "Biotic-Relationships")


# --- presence -------------------------------------------------------------------------------------

for _id, _acted, _consulted, _class, _uses in [
    ("BASISOFRECORD", BASIS, (), RECORD, (MANAGE, ALIEN)),
    ("COUNTRYCODE", CODE, (), LOCATION, (SPACE, MANAGE, ALIEN)),
    ("COUNTRY", COUNTRY, (CODE,), LOCATION, (SPACE, MANAGE)),
    ("DECIMALLATITUDE", LAT, (), LOCATION, (SPACE, ALIEN)),
    ("DECIMALLONGITUDE", LON, (), LOCATION, (SPACE, ALIEN)),
    ("EVENTDATE", DATE, (), EVENT, (SPACE, ALIEN)),
    ("OCCURRENCEID", OCCURRENCE, (), OCC, (MANAGE,)),
    ("SCIENTIFICNAME", NAME, (), TAXON, (TAXA, BIOTIC)),
    ("LICENSE", "dwc:license", (), RECORD, (MANAGE,)),
]:
    rule(f"VALIDATION_{_id}_NOTEMPTY", acted=[_acted], consulted=_consulted, ie_class=_class, usecases=_uses,
         description=f"Is there a value in {_acted}?")(B.not_empty(_acted))


# --- location -------------------------------------------------------------------------------------

for _suffix in ("INRANGE", "VALID"):
    rule(f"VALIDATION_DECIMALLATITUDE_{_suffix}", acted=[LAT], ie_class=LOCATION, usecases=(SPACE,),
         description="Is the latitude a number between -90 and 90?")(B.in_range(LAT, -90, 90))
    rule(f"VALIDATION_DECIMALLONGITUDE_{_suffix}", acted=[LON], ie_class=LOCATION, usecases=(SPACE,),
         description="Is the longitude a number between -180 and 180?")(B.in_range(LON, -180, 180))


@rule("VALIDATION_COORDINATES_NOTZERO", acted=[LAT, LON], ie_class=LOCATION, usecases=(SPACE,))
def coordinates_not_zero(v: Inputs) -> Column:
    """Are latitude and longitude not both zero? Non-numeric input cannot be tested (our choice)."""
    lat, lon = number(v[LAT]), number(v[LON])
    return F.when(lat.isNull() | lon.isNull(), B.unmet("Coordinates are empty or not numbers.")).otherwise(
        B.verdict((lat != 0) | (lon != 0), "Coordinates are not both zero.", "Coordinates are both zero."))


@rule("VALIDATION_COUNTRYCODE_STANDARD", acted=[CODE], needs=("iso_alpha2",), ie_class=LOCATION,
      usecases=(SPACE, MANAGE), params={"user_assigned": True})
def country_code_standard(v: Inputs) -> Column:
    """Is the value a two-letter country code, case-sensitively? User-assigned codes (``AA``, ``QM``-``QZ``,
    ``XA``-``XZ``, ``ZZ``) are accepted with ``user_assigned``, which is the default."""
    code = v[CODE]
    listed = v.answer("iso_alpha2").isNotNull() & (code == F.upper(code))
    if v.option("user_assigned"):
        listed = listed | code.rlike("^(AA|Q[M-Z]|X[A-Z]|ZZ)$")
    return F.when(blank(code), B.unmet("countryCode is empty.")).otherwise(
        B.verdict(listed, "countryCode is a two-letter country code.", "countryCode is not a two-letter country code."))


@rule("VALIDATION_COUNTRY_FOUND", acted=[COUNTRY], needs=("iso_name",), ie_class=LOCATION, usecases=(SPACE, MANAGE))
def country_found(v: Inputs) -> Column:
    """Is the country name in the authority? Names are matched without case and outer spaces."""
    return F.when(blank(v[COUNTRY]), B.unmet("country is empty.")).otherwise(
        B.verdict(v.answer("iso_name").isNotNull(), "country is a known country name.", "country is not a known country name."))


rule("VALIDATION_COUNTRYCOUNTRYCODE_CONSISTENT", acted=[COUNTRY, CODE], needs=("iso_name",), ie_class=LOCATION,
     usecases=(SPACE, MANAGE), description="Does the country name belong to the country code?")(
    B.consistent(COUNTRY, CODE, lambda v: v.answer("iso_name")["alpha2"]))


@rule("AMENDMENT_COUNTRYCODE_STANDARDIZED", "Amendment", acted=[CODE],
      needs=("iso_alpha2", "iso_alpha3", "iso_code_name"), ie_class=LOCATION, usecases=(SPACE, MANAGE))
def country_code_standardized(v: Inputs) -> Column:
    """Propose the two-letter code for a lower-case code, a three-letter code or a country name (our choice
    of accepted spellings)."""
    return B.standardize(
        CODE,
        standard=lambda x: F.coalesce(x.answer("iso_alpha2")["alpha2"], x.answer("iso_alpha3")["alpha2"],
                                      x.answer("iso_code_name")["alpha2"]),
        valid=lambda x: x.answer("iso_alpha2")["alpha2"] == x[CODE],
    )(v)


def _in_country(v: Inputs) -> Column:
    """Is the point inside the country of its code, within the buffer? An unknown code or point cannot be
    tested; a point outside every country is not compliant (our choice)."""
    lat, lon = number(v[LAT]), number(v[LON])
    code = v.answer("iso_alpha2")["alpha2"]
    return (
        F.when(B.any_blank(v, LAT, LON, CODE) | lat.isNull() | lon.isNull(), B.unmet("Coordinates or code are empty or unreadable."))
        .when(code.isNull() | (code != v[CODE]), B.unmet("The country code is not known."))
        .otherwise(B.verdict(F.array_contains(v.answer("geo_near"), code),
                             "The point lies in the country.", "The point lies outside the country."))
    )


for _id in ("VALIDATION_COORDINATESCOUNTRYCODE_CONSISTENT", "VALIDATION_COORDINATES_IN_COUNTRY"):
    rule(_id, acted=[LAT, LON, CODE], needs=("iso_alpha2", "geo_near"), ie_class=LOCATION, usecases=(SPACE,),
         params={"spatialBufferInMeters": 0.0}, param_types={"spatialBufferInMeters": "number"})(_in_country)


@rule("VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT", acted=[LAT, LON], consulted=[NAME],
      needs=("geo_points", "habitat"), ie_class=LOCATION, usecases=(SPACE, ALIEN))
def habitat_consistent(v: Inputs) -> Column:
    """Does the taxon's habitat agree with land or sea at the point? Unknown habitat cannot be tested."""
    habitat, on_land = v.answer("habitat")["habitat"], F.size(v.answer("geo_points")[0]) > 0
    return (
        F.when(B.any_blank(v, LAT, LON, NAME) | number(v[LAT]).isNull() | number(v[LON]).isNull(),
               B.unmet("Coordinates or name are empty."))
        .when(habitat.isNull(), B.unmet("The habitat of the taxon is not known."))
        .otherwise(B.verdict((habitat == "both") | (F.coalesce(on_land, F.lit(False)) == (habitat == "terrestrial")),
                             "Habitat and coordinates agree.", "Habitat and coordinates do not agree."))
    )


@rule("AMENDMENT_COORDINATES_TRANSPOSED", "Amendment", acted=[LAT, LON], consulted=[CODE],
      needs=("iso_alpha2", "geo_points"), ie_class=LOCATION, usecases=(SPACE,))
def coordinates_transposed(v: Inputs) -> Column:
    """Propose swapped or sign-changed coordinates when only those lie in the country of the code. The first
    variant that fits, in the order of :data:`POINT_VARIANTS`, is taken (our choice)."""
    code, points = v.answer("iso_alpha2")["alpha2"], v.answer("geo_points")
    lat, lon = number(v[LAT]), number(v[LON])
    out = (
        F.when(B.any_blank(v, LAT, LON, CODE) | lat.isNull() | lon.isNull(), B.unmet("Coordinates or code are empty."))
        .when(code.isNull() | (code != v[CODE]), B.unchanged("The country code is not known."))
        .when(F.array_contains(points[0], code), B.unchanged("The point lies in the country as given."))
    )
    for i, (swap, flip_lat, flip_lon) in enumerate(POINT_VARIANTS):
        if i == 0:
            continue
        first, second = (v[LON], v[LAT]) if swap else (v[LAT], v[LON])
        first = _negated(first) if flip_lat else strip(first)
        second = _negated(second) if flip_lon else strip(second)
        out = out.when(F.array_contains(points[i], code),
                       B.changed({LAT: first, LON: second}, "Coordinates transposed or sign changed."))
    return out.otherwise(B.unchanged("No variant of the point lies in the country."))


# Point variants as (swapped, latitude negated, longitude negated), tried in this order.
POINT_VARIANTS = [
    (False, False, False), (False, True, False), (False, False, True), (False, True, True),
    (True, False, False), (True, True, False), (True, False, True), (True, True, True),
]


def _negated(text: Column) -> Column:
    t = strip(text)
    return F.when(t.startswith("-"), F.substr(t, F.lit(2))).otherwise(
        F.concat(F.lit("-"), F.regexp_replace(t, r"^\+", "")))


@rule("AMENDMENT_COUNTRYCODE_FROM_COORDINATES", "Amendment", acted=[CODE], consulted=[LAT, LON],
      needs=("geo_points",), ie_class=LOCATION, usecases=(SPACE, MANAGE))
def country_code_from_coordinates(v: Inputs) -> Column:
    """Fill an empty country code with the country the point lies in."""
    return B.fill_from({CODE: lambda x: F.try_element_at(x.answer("geo_points")[0], F.lit(1))}, [LAT, LON])(v)


@rule("AMENDMENT_COORDINATES_DECIMAL", "Amendment", acted=[LAT, LON], ie_class=LOCATION, usecases=(SPACE,))
def coordinates_decimal(v: Inputs) -> Column:
    """Convert degree-minute-second coordinates to decimal degrees with three places."""
    def outcome(p: Column) -> Column:
        return (
            F.when(B.any_blank(v, LAT, LON), B.unmet("Coordinates are empty."))
            .when(p["lat"].isNotNull() & p["lon"].isNotNull(), B.changed({LAT: p["lat"], LON: p["lon"]}, "Converted to decimal degrees."))
            .otherwise(B.unchanged("Coordinates are not in degrees, minutes and seconds."))
        )

    return let(F.struct(plain_number(dms_to_decimal(v[LAT])).alias("lat"), plain_number(dms_to_decimal(v[LON])).alias("lon")), outcome)


_VLAT, _VLON, _VSRS = "dwc:verbatimLatitude", "dwc:verbatimLongitude", "dwc:verbatimSRS"


@rule("AMENDMENT_COORDINATES_FROM_VERBATIM", "Amendment", acted=[LAT, LON, "dwc:geodeticDatum"],
      consulted=[_VLAT, _VLON, _VSRS], ie_class=LOCATION, usecases=(SPACE,))
def coordinates_from_verbatim(v: Inputs) -> Column:
    """Fill latitude, longitude and datum from the verbatim fields, decimal or degree-minute-second."""
    def decimal(name: str, limit: float):
        def f(x: Inputs) -> Column:
            plain = number(x[name])
            dms = dms_to_decimal(x[name], 7)
            text = F.when(plain.isNotNull(), strip(x[name])).otherwise(plain_number(dms))
            return F.when(F.abs(F.coalesce(plain, dms)) <= limit, text)
        return f
    return B.fill_from({LAT: decimal(_VLAT, 90), LON: decimal(_VLON, 180),
                        "dwc:geodeticDatum": lambda x: strip(x[_VSRS])}, [_VLAT, _VLON, _VSRS])(v)


@rule("ISSUE_COORDINATES_WITHOUT_UNCERTAINTY", "Issue", acted=[LAT, LON, "dwc:coordinateUncertaintyInMeters"],
      ie_class=LOCATION, usecases=(SPACE,))
def uncertainty_missing(v: Inputs) -> Column:
    """Are there coordinates without an uncertainty?"""
    return F.when(B.any_blank(v, LAT, LON), B.unmet("Coordinates are empty.")).otherwise(
        B.issue(blank(v["dwc:coordinateUncertaintyInMeters"]), "Coordinates have no uncertainty.", "An uncertainty is given."))


for _what in ("Depth", "Elevation"):
    _lo, _hi = f"dwc:minimum{_what}InMeters", f"dwc:maximum{_what}InMeters"
    rule(f"VALIDATION_MIN{_what.upper()}_LESSTHAN_MAX{_what.upper()}", acted=[_lo, _hi], ie_class=LOCATION,
         usecases=(SPACE,), description=f"Is {_lo} not greater than {_hi}?")(B.less_than(_lo, _hi))
for _end, _name in (("MIN", "dwc:minimumElevationInMeters"), ("MAX", "dwc:maximumElevationInMeters")):
    rule(f"VALIDATION_{_end}ELEVATION_INRANGE", acted=[_name], ie_class=LOCATION, usecases=(SPACE,),
         description=f"Is {_name} between -430 and 8850?")(B.in_range(_name, -430, 8850))


@rule("AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM", "Amendment", consulted=["dwc:verbatimDepth"],
      acted=["dwc:minimumDepthInMeters", "dwc:maximumDepthInMeters"], ie_class=LOCATION, usecases=(SPACE,))
def depth_from_verbatim(v: Inputs) -> Column:
    """Fill both depths in metres from ``10 feet`` or ``10-20 m``."""
    def end(which: int):
        def f(x: Inputs) -> Column:
            text = strip(x["dwc:verbatimDepth"])
            pattern = r"^([0-9.]+)\s*(?:-|–|to)\s*([0-9.]+)\s*([A-Za-z]*)\.?$"
            part = F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, which), F.lit(" "),
                                                        F.regexp_extract(text, pattern, 3))).otherwise(text)
            return plain_number(metres(part))
        return f
    return B.fill_from({"dwc:minimumDepthInMeters": end(1), "dwc:maximumDepthInMeters": end(2)}, ["dwc:verbatimDepth"])(v)


# --- event ----------------------------------------------------------------------------------------

def _interval_rule(name: str, test, yes: str, no: str, **more):
    @rule(name, acted=[DATE], ie_class=EVENT, usecases=(SPACE,), description=yes, **more)
    def fn(v: Inputs) -> Column:
        return let(iso_interval(v[DATE]), lambda i: F.when(i.isNull(), B.unmet("eventDate is empty or not an ISO date.")).otherwise(
            B.verdict(test(v, i), yes, no)))
    return fn


_interval_rule("EVENT_DATE_PRECISON_JULIAN_YEAR_OR_BETTER", lambda v, i: duration_days(i) <= 365.25,
               "eventDate lasts at most one Julian year.", "eventDate lasts longer than one Julian year.")
_interval_rule("EVENT_DATE_YEAR_INCOMPLETE", lambda v, i: ~has_leap_day(i) & (duration_days(i) <= 365),
               "eventDate has no leap day and lasts at most one calendar year.",
               "eventDate has a leap day or lasts longer than one calendar year.")
_interval_rule("VALIDATION_EVENTDATE_INRANGE",
               lambda v, i: (i["start"] >= v.param("earliestValidDate").try_cast("date")) & (
                   i["end"] <= F.coalesce(v.param("latestValidDate").try_cast("date"),
                                          F.make_date(F.year(F.current_date()), F.lit(12), F.lit(31)))),
               "eventDate lies within the valid range.", "eventDate lies outside the valid range.",
               params={"earliestValidDate": "1582-11-15", "latestValidDate": None}, param_types={"earliestValidDate": "date", "latestValidDate": "date"})


@rule("VALIDATION_EVENTDATE_STANDARD", acted=[DATE], ie_class=EVENT, usecases=(SPACE,))
def event_date_standard(v: Inputs) -> Column:
    """Is the value a valid ISO date or interval?"""
    return F.when(blank(v[DATE]), B.unmet("eventDate is empty.")).otherwise(
        B.verdict(iso_interval(v[DATE]).isNotNull(), "eventDate is an ISO date.", "eventDate is not an ISO date."))


@rule("ISSUE_EVENTDATE_AMBIGUOUS", "Issue", acted=[DATE], ie_class=EVENT, usecases=(SPACE,))
def event_date_ambiguous(v: Inputs) -> Column:
    """Can day and month of the date be swapped?"""
    return F.when(blank(v[DATE]), B.unmet("eventDate is empty.")).otherwise(
        B.issue(ambiguous_date(v[DATE]), "The date layout may be ambiguous.", "The date layout is not ambiguous."))


@rule("AMENDMENT_EVENTDATE_STANDARDIZED", "Amendment", acted=[DATE], ie_class=EVENT, usecases=(SPACE,),
      params={"day_first": None})
def event_date_standardized(v: Inputs) -> Column:
    """Propose the ISO form of a date in another layout; ``a/b/y`` dates stay AMBIGUOUS unless ``day_first``
    settles them."""
    def outcome(standard: Column) -> Column:
        return (
            F.when(blank(v[DATE]), B.unmet("eventDate is empty."))
            .when(iso_interval(v[DATE]).isNotNull(), B.unchanged("eventDate is an ISO date."))
            .when(standard.isNotNull(), B.changed({DATE: standard}, "eventDate standardised."))
            .when(ambiguous_date(v[DATE]), B.response(N.AMBIGUOUS, "", "Day and month cannot be told apart."))
            .otherwise(B.unchanged("eventDate cannot be read as a date."))
        )

    return let(standard_date(v[DATE], v.option("day_first")), outcome)


@rule("VALIDATION_EVENT_CONSISTENT", acted=[DATE, "dwc:year", "dwc:month", "dwc:day"], ie_class=EVENT, usecases=(SPACE,))
def event_consistent(v: Inputs) -> Column:
    """Do year, month and day agree with the event date? Blank parts are skipped; all blank cannot be tested."""
    parts = {n: v["dwc:" + n] for n in ("year", "month", "day")}
    all_blank = blank(parts["year"]) & blank(parts["month"]) & blank(parts["day"])

    def outcome(i: Column) -> Column:
        def agrees(part: Column, of) -> Column:
            n = strip(part).try_cast("int")
            return blank(part) | F.coalesce(n.between(of(i["start"]), of(i["end"])), F.lit(False))

        same_year = F.year(i["start"]) == F.year(i["end"])
        same_month = same_year & (F.month(i["start"]) == F.month(i["end"]))
        ok = agrees(parts["year"], F.year) & (~same_year | agrees(parts["month"], F.month)) & (
            ~same_month | agrees(parts["day"], F.dayofmonth))
        return F.when(i.isNull() | all_blank, B.unmet("eventDate, or all of year, month and day, is empty.")).otherwise(
            B.verdict(ok, "year, month and day agree with eventDate.", "year, month or day disagrees with eventDate."))

    return let(iso_interval(v[DATE]), outcome)


# --- record, occurrence, taxon ----------------------------------------------------------------------

rule("VALIDATION_BASISOFRECORD_STANDARD", acted=[BASIS], ie_class=RECORD, usecases=(MANAGE,),
     description="Is the basis of record a listed term?")(B.in_vocabulary(BASIS, BASIS_TERMS))
rule("AMENDMENT_BASISOFRECORD_STANDARDIZED", "Amendment", acted=[BASIS], ie_class=RECORD, usecases=(MANAGE,),
     description="Propose the listed term for a case or spacing variant (our choice of variants).")(
    B.standardize(BASIS, lambda v: B.lookup_literal(B.fold(v[BASIS]), B.folded_terms(BASIS_TERMS)),
                  lambda v: v[BASIS].isin(*BASIS_TERMS)))
rule("VALIDATION_LICENSE_STANDARD", acted=["dwc:license"], ie_class=RECORD, usecases=(MANAGE,),
     description="Is the license a known open licence?")(B.matches("dwc:license", LICENSE_PATTERN, "a known open licence"))
rule("VALIDATION_OCCURRENCEID_STANDARD", acted=[OCCURRENCE], ie_class=OCC, usecases=(MANAGE,),
     description="Is the identifier a URI with host and path, a URN or a UUID (our choice of forms)?")(
    B.matches(OCCURRENCE, r"(?i)^([a-z][a-z0-9+.\-]*://[^/\s]+/\S+|urn:[a-z0-9][a-z0-9\-]{0,31}:\S+|"
                          r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$", "a full identifier"))


@rule("VALIDATION_SCIENTIFICNAME_FOUND", acted=[NAME], needs=("taxon_name",), ie_class=TAXON, usecases=(TAXA, BIOTIC))
def scientific_name_found(v: Inputs) -> Column:
    """Is the name in the backbone, authorship included? A match of the bare name alone is not compliant."""
    return F.when(blank(v[NAME]), B.unmet("scientificName is empty.")).otherwise(
        B.verdict(v.answer("taxon_name").isNotNull(), "scientificName is in the backbone.", "scientificName is not in the backbone."))


@rule("VALIDATION_PHYLUM_FOUND", acted=["dwc:phylum"], needs=("phylum",), ie_class=TAXON, usecases=(TAXA,))
def phylum_found(v: Inputs) -> Column:
    """Is the phylum in the backbone?"""
    return F.when(blank(v["dwc:phylum"]), B.unmet("phylum is empty.")).otherwise(
        B.verdict(v.answer("phylum").isNotNull(), "phylum is in the backbone.", "phylum is not in the backbone."))


rule("VALIDATION_SCIENTIFICNAME_FORMAT", acted=[NAME], ie_class=TAXON, usecases=(TAXA,),
     description="Does the name start with a capitalised genus and a lower-case epithet?")(
    B.matches(NAME, r"^\s*[A-Z][a-zë\-]+ (x |× )?[a-zë\-]+(\s.*)?$", "a genus followed by an epithet"))
for _suffix in ("VALID", "STANDARD"):
    rule(f"VALIDATION_TAXONRANK_{_suffix}", acted=[RANK], ie_class=TAXON, usecases=(TAXA,),
         description="Is the rank a listed term?")(B.in_vocabulary(RANK, RANK_TERMS))
rule("AMENDMENT_TAXONRANK_STANDARDIZED", "Amendment", acted=[RANK], ie_class=TAXON, usecases=(TAXA,),
     description="Propose the listed rank for an abbreviation or a case variant.")(
    B.standardize(RANK, lambda v: B.lookup_literal(F.lower(F.regexp_replace(strip(v[RANK]), r"[\s.]+$", "")),
                                                   {**RANK_SYNONYMS, **{t: t for t in RANK_TERMS}}),
                  lambda v: v[RANK].isin(*RANK_TERMS)))


@rule("AMENDMENT_SCIENTIFICNAME_CORRECTED", "Amendment", acted=[NAME], ie_class=TAXON, usecases=(TAXA,))
def scientific_name_corrected(v: Inputs) -> Column:
    """Propose a capital first letter and a lower-case rest for two- and three-part names of letters only, so
    that authorship is never touched (our choice)."""
    text = F.regexp_replace(strip(v[NAME]), r"\s+", " ")
    fixed = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    plain = text.rlike(r"^([a-z][A-Za-z\-]* [A-Za-z\-]+( [A-Za-z\-]+)?|[A-Z\-]+ [A-Z\-]+( [A-Z\-]+)?)$")
    return (
        F.when(blank(v[NAME]), B.unmet("scientificName is empty."))
        .when(plain & (fixed != v[NAME]), B.changed({NAME: fixed}, "Capitalisation corrected."))
        .otherwise(B.unchanged("scientificName needs no correction of case."))
    )
