"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same for each mention.

Mentions are found with one pattern and reduced to a canonical value, so that two spellings of a number are one entity.
Each distinct entity draws a surrogate from a keyed hash in the shape of the value: digits for digits, letters for
letters, the same country code, network, honorific, gender and script.  A check over all entities sends back those whose
surrogate another entity has, or that is itself an entity of the corpus, and they draw again; what draws don't settle is
ranked and gets a surrogate that holds its rank.  A family name is an entity of its own, so two families never get one
surrogate under whatever given names; of a full name only the given one is drawn besides.  Surrogates are joined to the
mentions by entity and put back at their places.  A family name that a document gives with an honorific is replaced in the
rest of that document too, where it stands alone.  All steps are column expressions, joins and windows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.shared_store import written

#: Patterns of each type.  Runs are possessive and start at their first character, so a text of one long
#: run is read once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": r"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
    "phone": r"(?=[0-9+(])(?:(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<=[0-9+][ .-])[0-9]{3}[ .-]|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+.-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9])|(?<![0-9+])\+[1-9](?:[ .()-]{0,2}[0-9]){9,14}(?![0-9]))",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "man": r"(?<!\p{L})(?:Mr\.?|Herr|Monsieur|Señor|Sr\.|господин) \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?(?!\p{L})",
    "woman": r"(?<!\p{L})(?:Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Sra\.|госпожа) \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?(?!\p{L})",
}
#: Given names of either gender in Latin and Cyrillic script, and syllables for family names.
GIVEN = {
    ("man", "latin"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marc", "Nils", "Oscar", "Paul"],
    ("woman", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("man", "cyrillic"): ["Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Олег", "Павел", "Роман", "Семен", "Тимур", "Юрий"],
    ("woman", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Юлия"],
}
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu", "za"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ца"],
}
#: What a text has to hold, one of some strings or a digit, for mentions of some types; their patterns aren't tried on others.
HINTS = [
    (["@"], ["email"]),
    (None, ["ip", "ipv6", "phone", "ssn", "card"]),
    (["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-"], ["secret"]),
    (["Mr", "Ms", "Miss ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Mme ", "Señor", "Sr. ", "Sra. ", "господин ", "госпожа "], ["man", "woman"]),
]
#: What a surrogate key keeps, so that it is of the same sort.
KEY_PREFIX = r"^(?:sk-(?:proj-|svcacct-|admin-|ant-api[0-9]{2}-|or-v1-)?|github_pat_|.{4})"
TITLE = r"^(\p{L}+\.?) "
#: Codes of countries; one and two digits where given, else three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PEOPLE = ("man", "woman")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(surface: Column) -> Column:
    """The type of a mention: the first whose pattern it is as a whole."""
    out = None
    for name, pattern in PATTERNS.items():
        held = surface.rlike(f"^(?:{pattern})$")
        out = F.when(held, F.lit(name)) if out is None else out.when(held, F.lit(name))
    return F.coalesce(out, F.lit("phone"))


def canonical(kind: Column, surface: Column) -> Column:
    """What the spellings of one entity have in common: honorifics stay out of it, and so does the prefix +1, as ten digits
    alone are taken for a number of that country; a number of any other country keeps its code."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(surface))
        .when(kind == "phone", F.when(surface.rlike(r"^\+(?!1(?:[^0-9]*[0-9]){10}$)"), F.concat(F.lit("+"), _digits(surface))).otherwise(F.right(_digits(surface), F.lit(10))))
        .when(kind.isin("card", "ssn"), _digits(surface))
        .when(kind.isin("man", "woman"), F.regexp_replace(surface, TITLE, ""))
        .otherwise(surface)
    )


def hints(text: Column) -> Column:
    """A number whose bits say which of HINTS a text holds."""
    out = F.lit(0)
    for i, (strings, _) in enumerate(HINTS):
        held = functools.reduce(Column.__or__, map(text.contains, strings)) if strings else text.rlike("[0-9]")
        out = out + F.when(held, 1 << i).otherwise(0)
    return out


def _by_hints(code: Column, of, none: Column) -> Column:
    """of(pattern) with the patterns of the types that a text can hold, in their order; none for a text without hints."""
    out = F.when(code == 0, none)
    for number in range(1, 1 << len(HINTS)):
        kinds = {k for i, (_, own) in enumerate(HINTS) if number >> i & 1 for k in own}
        out = out.when(code == number, of("|".join(f"(?:{p})" for k, p in PATTERNS.items() if k in kinds)))
    return out


def _draw(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _pick(hashed: Column, at: int, choices: list[str]) -> Column:
    """One of 16 choices by a hexadecimal digit."""
    return F.get(F.array(*map(F.lit, choices)), F.conv(F.substring(hashed, at, 1), 16, 10).cast("int"))


def _shaped(value: Column, hashed: Column) -> Column:
    """Random characters in the shape of value: digits, small and capital letters as they stand, all else unchanged."""
    digits = F.translate(hashed, "abcdef", "270491")
    letters = F.translate(hashed, "0123456789abcdef", "bcdfghjkmnpqrtvw")

    def one(c: Column, i: Column) -> Column:
        at = i % 64 + 1
        return (
            F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substr(letters, at, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.upper(F.substr(letters, at, F.lit(1))))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(number: Column, shift: int) -> Column:
    """Luhn's sum of a digit string; shift 1: of the digits before a check digit still to come."""
    digits = F.reverse(F.split(number, ""))

    def add(total: Column, x: Column) -> Column:
        return total + x

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((i + shift) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(digits, weigh), F.lit(0), add)


def _given(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """A full name with a given name of the same gender and script in place of its own; its family stays for now."""
    first, family = F.split_part(value, F.lit(" "), F.lit(1)), F.split_part(value, F.lit(" "), F.lit(-1))
    hashed, out = _draw(key, F.lit("given"), kind, first, attempt), None
    for (gender, script), given in GIVEN.items():
        held = (kind == gender) & (value.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic"))
        full = F.concat(_pick(hashed, 1, given), F.lit(" "), family)
        out = F.when(held, full) if out is None else out.when(held, full)
    return out


def _family(value: Column, key: str, attempt: Column) -> Column:
    """A family name of the same script."""
    hashed = _draw(key, F.lit("family"), value, attempt)
    latin, cyrillic = (F.initcap(F.concat(*(_pick(hashed, at, SYLLABLES[script]) for at in range(1, 7)))) for script in ("latin", "cyrillic"))
    return F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate that an entity draws at an attempt."""
    hashed = _draw(key, kind, value, attempt)
    plain = _shaped(value, hashed)
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    host = F.split_part(domain, F.lit("."), F.lit(1))
    email = F.concat(_shaped(local, hashed), F.lit("@"), _shaped(host, _draw(key, F.lit("host"), domain)), F.lit(".example.com"))
    octets = [((F.conv(F.substring(hashed, 4 * i + 1, 4), 16, 10).cast("int") % (223 if i == 0 else 256)) + (1 if i == 0 else 0)).cast("string") for i in range(4)]
    area = (F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int") % 800 + 200).cast("string")
    code = F.regexp_extract(value, COUNTRY, 0)
    abroad = F.concat(code, F.substr(plain, F.length(code) + 1))
    phone = F.when(code == "", F.concat(area, F.lit("555"), F.right(plain, F.lit(4)))).otherwise(abroad)
    body = F.concat(F.left(value, F.lit(1)), F.substr(plain, F.lit(2), F.length(value) - 2))
    check = ((10 - _luhn_sum(body, 1) % 10) % 10 + F.when(_luhn_sum(value, 0) % 10 == 0, 0).otherwise(1)) % 10
    ssn = F.concat(F.lit("9"), F.substr(plain, F.lit(2)))
    prefix = F.regexp_extract(value, KEY_PREFIX, 0)
    secret = F.concat(prefix, F.substr(plain, F.length(prefix) + 1))
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *(F.substring(hashed, 4 * i + 1, 4) for i in range(6)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "ipv6", ipv6)
        .when(kind == "phone", phone)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ssn", ssn)
        .when(kind == "secret", secret)
        .when(kind == "family", _family(value, key, attempt))
        .otherwise(_given(kind, value, key, attempt))
    )


def in_format(kind: Column, surface: Column, drawn: Column) -> Column:
    """A surrogate in the spelling of a mention: its separators and prefix, its capitals, its honorific."""
    number = _digits(drawn)
    prefix = F.length(_digits(surface)) - F.length(number)

    def step(state: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        at = state["k"] - prefix
        filled = F.when(at >= 0, F.substr(number, at + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["s"], F.when(digit, filled).otherwise(c)).alias("s"), (state["k"] + digit.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    digits = F.aggregate(F.split(surface, ""), start, step, lambda state: state["s"])
    title = F.regexp_extract(surface, TITLE, 0)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.when(prefix < 0, drawn).otherwise(digits))
        .when(kind.isin("man", "woman"), F.concat(title, drawn))
        .when((kind == "email") & (surface == F.upper(surface)), F.upper(drawn))
        .otherwise(drawn)
    )


def placed(kind: Column, value: Column, key: str, rank: Column) -> Column:
    """A surrogate that no other rank of the kind has: the rank is written into it, in as many characters as it needs."""
    zero = F.lit("0")
    drawn = surrogate(kind, value, key, zero)
    first = F.conv(F.substring(_draw(key, F.lit("start"), kind), 1, 8), 16, 10).cast("bigint")
    at = first + rank  # so that ranks begin at a keyed place of a space of numbers
    local = F.split_part(drawn, F.lit("@"), F.lit(1))
    email = F.concat(local, F.lit("."), rank.cast("string"), F.lit("@"), F.split_part(drawn, F.lit("@"), F.lit(2)))
    number = at % (223 << 24) + (1 << 24)
    ip = F.concat_ws(".", *(F.shiftright(number, 8 * i).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for i in (3, 2, 1, 0)))
    code = F.regexp_extract(value, COUNTRY, 0)
    size = F.length(value) - F.length(code)
    room = F.pow(F.lit(10.0), size).cast("bigint")
    abroad = F.when(rank < room, F.lpad((at % room).cast("string"), size, "0")).otherwise(rank.cast("string"))
    phone = F.when(code == "", (F.lit(2_000_000_000).cast("bigint") + at % 8_000_000_000).cast("string")).otherwise(F.concat(code, abroad))
    groups = F.lpad(F.lower(F.hex(rank)), 16, "0")
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), F.lit("0"), F.lit("0"), *(F.substring(groups, 4 * i + 1, 4) for i in range(4)))
    inner = F.length(value) - 2
    body = F.concat(F.left(value, F.lit(1)), F.lpad(F.right(at.cast("string"), inner), inner, "0"))
    check = ((10 - _luhn_sum(body, 1) % 10) % 10 + F.when(_luhn_sum(value, 0) % 10 == 0, 0).otherwise(1)) % 10
    ssn = F.lpad((at % 1_000_000_000).cast("string"), 9, "0")
    secret = F.concat(F.left(drawn, F.length(drawn) - 12), F.lpad(rank.cast("string"), 12, "0"))
    hexed, spelt = F.lower(F.lpad(F.hex(rank), 16, "0")), None
    start = F.least(F.lit(14), 17 - F.length(F.ltrim(hexed, F.lit("0"))))
    digits = F.split(F.substring(hexed, start, F.lit(16)), "")  # 3 or more: longer than any given name that is drawn
    for script, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        own = F.array_join(F.transform(digits, lambda c: F.get(table, F.conv(c, 16, 10).cast("int"))), "")  # noqa: B023
        spelt = own if spelt is None else F.when(value.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic"), own).otherwise(spelt)
    name = F.when(kind == "family", F.concat(drawn, spelt)).otherwise(F.concat(F.initcap(spelt), F.lit(" "), F.split_part(drawn, F.lit(" "), F.lit(-1))))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone).when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ssn", ssn).when(kind == "secret", secret).otherwise(name)
    )


def _ranked(pending: DataFrame, key: str, start: int) -> tuple[DataFrame, int]:
    """pending with a rank from start on in keyed order, by ranges and their offsets; and the next rank."""
    sorted_ = pending.withColumn("h", _draw(key, F.lit("rank"), F.col("kind"), F.col("value"))).repartitionByRange("h", "value").sortWithinPartitions("h", "value")
    sorted_ = written(sorted_.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    offsets, total = [], start
    for row in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a range
        offsets.append((row["part"], total))
        total += row["n"]
    offset = F.broadcast(pending.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    rank = F.col("offset") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(offset, part == F.col("part")).select("kind", "value", rank.alias("rank")), total


def assign(entities: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """(kind, value, drawn) for distinct entities (kind, value): no two share a surrogate, and none is an entity.

    Entities draw again while draws still settle half of them, at most attempts times.  The others are ranked and have
    their rank written into the surrogate; ranks are never used twice, so all are settled however many they are.
    """
    pending, accepted, left, rank, draws = entities, None, None, 0, 0
    known = entities.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    while True:
        if draws is not None:
            drawn = pending.withColumn("drawn", surrogate(F.col("kind"), F.col("value"), key, F.lit(str(draws))))
        else:
            numbered, rank = _ranked(pending, key, rank)
            drawn = numbered.select("kind", "value", placed(F.col("kind"), F.col("value"), key, F.col("rank")).alias("drawn"))
        turn = F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("value"))
        real = (F.col("kind") == F.col("k")) & (F.lower("drawn") == F.lower("v"))
        judged = drawn.withColumn("turn", turn).join(known, real, "left").withColumn("free", (F.col("turn") == 1) & F.col("v").isNull())
        if accepted is not None:
            earlier = accepted.select(F.col("kind").alias("ak"), F.col("drawn").alias("ad"))
            judged = judged.join(earlier, (F.col("kind") == F.col("ak")) & (F.col("drawn") == F.col("ad")), "left")
            judged = judged.withColumn("free", F.col("free") & F.col("ad").isNull())
        judged = written(judged.groupBy("kind", "value", "drawn").agg(F.bool_and("free").alias("free")))
        good = judged.filter("free").select("kind", "value", "drawn")
        accepted = good if accepted is None else accepted.union(good)
        pending = judged.filter("NOT free").select("kind", "value")
        before, left = left, pending.count()
        if not left:
            return accepted
        if draws is not None:
            draws = draws + 1 if draws + 1 < attempts and (before is None or 2 * left <= before) else None


def _bare_names(mentions: DataFrame) -> Column:
    """(family, new) of the people that a document names: distinct families of three letters or more, each with the least new one."""
    family, drawn = F.split_part("value", F.lit(" "), F.lit(-1)), F.split_part("drawn", F.lit(" "), F.lit(-1))
    person = F.col("kind").isin("man", "woman") & (F.length(family) >= 3)
    return F.array_sort(F.collect_set(F.when(person, F.struct(family.alias("family"), drawn.alias("new")))))


def _without_bare(part: Column, names: Column) -> Column:
    """A stretch between mentions with the families replaced."""

    def step(text: Column, name: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), name["family"], F.lit(r"(?!\p{L})")), name["new"])

    return F.aggregate(names, part, step)


def _count_bare(part: Column, names: Column) -> Column:
    def step(n: Column, name: Column) -> Column:
        return n + F.regexp_count(part, F.concat(F.lit(r"(?<!\p{L})"), name["family"], F.lit(r"(?!\p{L})")))

    return F.aggregate(names, F.lit(0), step)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_entities (mentions), kinds (array<string>, sorted), text with surrogates.

    The same key gives the same surrogates for the same corpus.  A null text is empty.  Repeated rows and null ids give a
    row each; an empty table gives none.  Other columns of docs are not read, so their names can't clash.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    source = source.withColumn("_row", F.xxhash64("_id", "_text")).withColumn("_row2", F.xxhash64(F.lit(7), "_text"))
    surfaces = _by_hints(F.col("_code"), lambda p: F.regexp_extract_all("_text", F.lit(p), F.lit(0)), F.array().cast("array<string>"))
    mentions = source.withColumn("_code", hints(F.col("_text"))).select("_row", "_row2", F.posexplode(surfaces).alias("_pos", "_surface")).withColumn("kind", kind_of(F.col("_surface")))
    mentions = written(mentions.withColumn("value", canonical(F.col("kind"), F.col("_surface"))).distinct())

    family = F.split_part("value", F.lit(" "), F.lit(-1))
    people = F.col("kind").isin(*PEOPLE)
    families = mentions.filter(people).select(F.lit("family").alias("kind"), family.alias("value"))
    entities = mentions.filter(~people | F.col("value").contains(" ")).select("kind", "value")
    drawn = assign(entities.union(families).distinct(), key)
    new = drawn.filter("kind = 'family'").select(F.col("value").alias("_family"), F.col("drawn").alias("_new_family"))
    others = mentions.filter(~people).join(drawn, ["kind", "value"])
    given = F.when(F.col("value").contains(" "), F.concat(F.split_part("drawn", F.lit(" "), F.lit(1)), F.lit(" "))).otherwise("")
    persons = mentions.filter(people).join(drawn, ["kind", "value"], "left").join(new, family == F.col("_family"))
    named = others.unionByName(persons.withColumn("drawn", F.concat(given, "_new_family")).select(others.columns))
    named = named.withColumn("_new", in_format(F.col("kind"), F.col("_surface"), F.col("drawn")))
    found = named.groupBy(F.col("_row").alias("_found"), F.col("_row2").alias("_found2")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_new"))).alias("_all"), F.array_sort(F.collect_set("kind")).alias("kinds"), _bare_names(named).alias("_bare")
    )
    joined = source.join(found, (F.col("_row") == F.col("_found")) & (F.col("_row2") == F.col("_found2")), "left")
    # of names that share a family the first stands for it
    bare = F.filter("_bare", lambda x, i: (i == 0) | (x["family"] != F.get(F.col("_bare"), i - 1)["family"]))
    joined = joined.withColumn("_bare", bare).withColumn("_code", F.when(F.col("_all").isNotNull(), hints(F.col("_text"))))
    joined = joined.withColumn("_parts", F.when(F.col("_all").isNotNull(), _by_hints(F.col("_code"), lambda p: F.split("_text", p), F.array("_text"))))
    joined = joined.withColumn("_more", F.aggregate("_parts", F.lit(0), lambda n, part: n + _count_bare(part, F.col("_bare"))))
    pieced = F.array_join(F.transform("_parts", lambda part, i: F.concat(_without_bare(part, F.col("_bare")), F.coalesce(F.get(F.col("_all"), i)["_new"], F.lit("")))), "")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.array_size("_all") + F.col("_more"), F.lit(0)).cast("bigint").alias("n_entities"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        F.when(F.col("_all").isNull(), F.col("_text")).otherwise(pieced).alias("text"),
    )
