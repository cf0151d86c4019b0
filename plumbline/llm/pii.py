"""Personal data replaced by surrogates; DataFrame functions only.

Detection is one pattern with an alternative for each kind: mail addresses, phone numbers, card numbers, account numbers, social
security numbers, network addresses, secrets in hex, and names after a title or a known given name.

Surrogates are keyed: a hash of (key, kind, canonical value, attempt) drives every choice. Canonical values ignore case and
separators, so all spellings of one value share one surrogate, in every document; a name is replaced part by part, so
"Dr. Anna Miller" and "Mrs. Miller" keep one surname. Format: digits become digits and letters letters of the same case and script,
separators and titles stay, names keep their case; given names keep gender and script. Mail goes to a reserved domain.

Collision checks: within a kind, two canonical values never share a surrogate and no surrogate equals a value that occurs. Values
that fail take the next attempt until none fails.

Shuffles carry distinct values and, for documents that hold some, the document; all others pass where they are read. A value in a
third of all rows is one row per task after partial aggregation, and its answers are joined by a plain equi-join.

Edge cases: a null text stays null, an empty one empty, both with no entities. Rows repeated with one id and text are replaced
alike, and null ids like others. Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

# Titles by gender, given names by script and gender, syllables and letters by script.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "latin": {
        "m": ["James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Paul", "Hans", "Karl", "Pierre", "Louis", "Carlos", "Jorge", "Miguel", "Peter"],
        "f": ["Mary", "Anna", "Linda", "Susan", "Karen", "Laura", "Julia", "Sarah", "Greta", "Heidi", "Claire", "Sophie", "Carmen", "Lucia", "Elena", "Maria"],
        "n": ["Alex", "Robin", "Kim", "Sam", "Jamie", "Taylor", "Jordan", "Morgan"],
    },
    "cyrillic": {
        "m": ["Иван", "Пётр", "Сергей", "Николай", "Андрей", "Олег"],
        "f": ["Анна", "Ольга", "Елена", "Мария", "Наталья", "Ирина"],
        "n": ["Саша", "Женя", "Валя"],
    },
}
SYLLABLES = {
    "latin": ["bar", "ben", "cal", "dor", "el", "fen", "gar", "hal", "ing", "jor", "kel", "lan", "mar", "nor", "or", "pel", "ros", "sten", "tor", "ul", "ven", "wil"],
    "cyrillic": ["бар", "бен", "вал", "гор", "дан", "ель", "зор", "кал", "лен", "мар", "нов", "ор", "пел", "рос", "тар", "фен"],
}
LETTERS = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{Ll}": "áàâäãéèêëíìîïóòôöõúùûüñç", r"\p{Lu}": "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ",
}
# Kinds in order of precedence, and their patterns.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_NAMES = "|".join(x for script in GIVEN.values() for names in script.values() for n in names for x in (n, n.upper()))
_TITLES = "|".join(dict.fromkeys(x for titles in TITLES.values() for t in titles for x in (t, t.upper())))
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})+",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{N}+])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?![\p{N}])",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": r"(?<![\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\p{N})|(?<![\p{N}])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\p{N})",
    "address": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}})",
    "secret": r"(?<![\p{L}\p{N}])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![\p{L}\p{N}])",
    "name": rf"(?=[A-ZА-ЯЁг])(?<!\p{{L}})(?:(?:{_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}}|(?:{_NAMES}) {_WORD})",
}
ANY = "|".join(PATTERNS.values())
PARTS = ["given", "surname"]
SPELLED = ["phone", "card", "account", "ssn"]  # kinds whose separators belong to the spelling
ATTEMPTS = 60


def _noise(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 hex digits drawn from key and value."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 512) for i in range(2)])


def _number(noise: Column, place: Column | int) -> Column:
    """The number that stands at a place of the noise, 0 to 4095."""
    at = (F.lit(place) if isinstance(place, int) else place) % 84 * 3 + 1
    return F.conv(noise.substr(at, F.lit(3)), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (number % len(items) + 1).cast("int"))


def _alike(value: Column, noise: Column, keep: int = 0) -> Column:
    """Each character replaced by one of its class; the first ``keep`` stay, and so do characters of no class."""
    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(LETTERS.items()):
            own = F.substring(F.lit(letters), 1, len(letters)).substr((_number(noise, i) % len(letters) + 1).cast("int"), F.lit(1))
            out = F.when(c.rlike(pattern), own).otherwise(out)
        return F.when(i < keep, c).otherwise(out)
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _given(gender: Column, script: Column, noise: Column, attempt: Column) -> Column:
    """A given name of the gender and script; later attempts join more names."""
    def name(place: int) -> Column:
        out = F.lit(None)
        for s, genders in GIVEN.items():
            for g, names in genders.items():
                out = F.when((script == s) & (gender == g), _pick(names, _number(noise, place))).otherwise(out)
        return out
    more = [F.when(attempt > 2 * i + 4, F.concat(F.lit("-"), name(i + 1))).otherwise("") for i in range(6)]
    return F.concat(name(0), *more)


def _surname(script: Column, noise: Column, attempt: Column) -> Column:
    """A surname of syllables; later attempts have more of them."""
    def syllable(place: int) -> Column:
        return reduce(lambda out, s: F.when(script == s, _pick(SYLLABLES[s], _number(noise, place))).otherwise(out), SYLLABLES, F.lit(None))
    more = [F.when(attempt > 3 * i, syllable(3 + i)).otherwise("") for i in range(8)]
    return F.initcap(F.concat(*[syllable(i) for i in range(3)], *more))


def _surrogate(key: str) -> Column:
    """The surrogate of a row ``kind, canon, gender, attempt``."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    noise, script = _noise(key, kind, canon, attempt), _script(canon)
    domain = F.concat(F.lit("@m"), F.substring(F.sha2(F.concat(F.lit(key), F.substring_index(canon, "@", -1)), 256), 1, 8), F.lit(".example.org"))
    octets = [(_number(noise, i) % 254 + 1).cast("string") for i in range(4)]
    hexes = F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: noise.substr((i + attempt) % 128 + 1, F.lit(1))), "")
    longer = F.when(attempt > 8, attempt.cast("string")).otherwise("")  # few mail names are that short
    return (F.when(kind == "mail", F.concat(_alike(F.substring_index(canon, "@", 1), noise), longer, domain))
            .when(kind == "address", F.concat_ws(".", *octets))
            .when(kind == "secret", hexes)
            .when(kind == "given", _given(F.col("gender"), script, noise, attempt))
            .when(kind == "surname", _surname(script, noise, attempt))
            .when(kind.isin("phone", "card"), _alike(canon, noise, keep=1))
            .when(kind == "account", _alike(canon, noise, keep=2))
            .otherwise(_alike(canon, noise)))


def _kind(value: Column) -> Column:
    """The first kind whose pattern matches the whole value."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^((?:{_TITLES})\.?) ", 1)


def _gender_of(word: Column, table: dict[str, list[str]]) -> Column:
    return reduce(lambda out, g: F.when(F.lower(word).isin([x.lower() for x in table[g]]), g).otherwise(out), table, F.lit("n"))


def _parts(values: DataFrame) -> DataFrame:
    """``value, parts``: what of each distinct value is replaced: (kind, canon, gender, text) in order of place."""
    value, kind = F.col("value"), _kind(F.col("value"))
    title = _title(value)
    words = F.filter(F.split(F.substring(value, F.when(title != "", F.length(title) + 2).otherwise(1), F.length(value)), " "), lambda w: w != "")
    by_list = {g: [n for script in GIVEN.values() for n in script[g]] for g in ("m", "f", "n")}
    by_title = _gender_of(F.regexp_replace(title, r"\.$", ""), TITLES)

    def word_part(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        listed = _gender_of(w, by_list)
        return F.struct(F.when(last, "surname").otherwise("given").alias("kind"), F.lower(w).alias("canon"),
                        F.when(last, "n").when(listed != "n", listed).otherwise(by_title).alias("gender"), w.alias("text"))

    canon = F.when(kind.isin(SPELLED), F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))).otherwise(F.lower(value))
    whole = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit("n").alias("gender"), value.alias("text")))
    return values.select("value", kind.alias("own"), title.alias("title"), F.when(kind == "name", F.transform(words, word_part)).otherwise(whole).alias("parts"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate``, distinct within a kind and unlike any value that occurs."""
    gender = F.when(F.min("sure") == F.max("sure"), F.min("sure")).otherwise("n")
    todo = (entities.withColumn("sure", F.when(F.col("gender") != "n", F.col("gender"))).groupBy("kind", "canon").agg(gender.alias("gender"))
            .withColumn("attempt", F.lit(0)))
    todo = cut(todo.withColumn("surrogate", _surrogate(key)))
    taken = todo.select("kind", F.lower("canon").alias("used"))
    for _ in range(ATTEMPTS):
        used = F.lower("surrogate")
        first = todo.groupBy("kind", used.alias("used")).agg(F.min(F.struct("attempt", "canon")).alias("first"))
        first = first.join(taken, ["kind", "used"], "left_anti")  # what equals a real value has no holder
        judged = cut(todo.withColumn("used", used).join(first, ["kind", "used"], "left"))
        settled = F.coalesce(F.col("first") == F.struct("attempt", "canon"), F.lit(False))
        failed = judged.where(~settled)
        if not failed.take(1):
            return judged.select("kind", "canon", "surrogate")
        # a settled value keeps its surrogate: it precedes every later attempt
        again = F.when(settled, F.col("attempt")).otherwise(F.col("attempt") + 1)
        moved = judged.select("kind", "canon", "gender", again.alias("attempt"), settled.alias("settled"), F.col("surrogate").alias("before"))
        todo = cut(moved.withColumn("surrogate", F.when(F.col("settled"), F.col("before")).otherwise(_surrogate(key)))
                   .select("kind", "canon", "gender", "attempt", "surrogate"))
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def _spelled(text: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the spelling of the text it replaces."""
    def step(acc: Column, c: Column) -> Column:
        own = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["out"], F.when(own, surrogate.substr(acc["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (acc["at"] + own.cast("int")).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    placed = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)["out"]
    upper = kind.isin(PARTS) & (F.upper(text) == text) & (F.length(text) > 1)
    return F.when(kind.isin(SPELLED), placed).when(upper, F.upper(surrogate)).otherwise(surrogate)


def _holds(text: Column) -> Column:
    """Whether a text holds anything; a text without digit and @ can only hold names, which spares it the other patterns."""
    return F.coalesce(F.when(text.rlike("[0-9@]"), text.rlike(ANY)).otherwise(text.rlike(PATTERNS["name"])), F.lit(False))


def _hits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, n_entities, kinds`` of every row; ``kinds`` lists the kinds found, sorted and joined by commas."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tag = F.xxhash64("text").alias("tag")
    held = cut(rows.where(_holds(F.col("text"))).select("id", tag, F.explode(F.array_distinct(_hits(F.col("text")))).alias("value")))
    parts = cut(_parts(held.select("value").distinct()))
    each = parts.select("value", "own", "title", F.posexplode("parts").alias("place", "part")).select("value", "own", "title", "place", "part.*")
    known = surrogates(each.select("kind", "canon", "gender"), key)
    spelled = each.join(known, ["kind", "canon"]).select("value", "own", "title", "place", _spelled(F.col("text"), F.col("surrogate"), F.col("kind")).alias("new"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"])
    title = F.first("title")
    answers = cut(spelled.groupBy("value", "own").agg(
        F.concat(F.when(title != "", F.concat(title, F.lit(" "))).otherwise(""), F.array_join(words, " ")).alias("new")))

    # a document's own answers: as many as it holds entities
    own = held.join(answers, "value").groupBy("id", "tag").agg(
        F.map_from_entries(F.collect_set(F.struct("value", "new"))).alias("new"), F.array_join(F.array_sort(F.collect_set("own")), ",").alias("kinds"))
    found = rows.where(_holds(F.col("text"))).withColumn("tag", F.xxhash64("text"))
    own = own.select(F.col("id").alias("own_id"), F.col("tag").alias("own_tag"), "new", "kinds")
    found = found.join(own, found["id"].eqNullSafe(own["own_id"]) & (found["tag"] == own["own_tag"]))
    hits, between = _hits(F.col("text")), F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(between, F.transform(hits, lambda h: F.element_at("new", h)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    found = found.select(F.col("id").alias(id_col), text.alias("text"), F.size(hits).cast("long").alias("n_entities"), "kinds")
    clean = rows.where(~_holds(F.col("text")))
    return found.unionByName(clean.select(F.col("id").alias(id_col), "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds")))
