"""Operator 5: personal data replaced by keyed, type-consistent surrogates.

Entities (e-mail, IP address, bank account, card, identity and phone numbers, titled names) are
found by one pattern. An entity's canonical form (case, separators and spacing removed) names it
everywhere, so mentions in different formats get the same surrogate (coreference). A surrogate is
a function of a secret key, the kind and the canonical form:
- letters become letters of the same script and case, digits digits, signs stay; an address keeps
  its top-level label; IP octets stay octets; a card keeps its first digit and a valid check digit, a
  bank account its country and valid check digits; a phone number its country code; a name gets names
  of the same gender and script;
- parts that recur have surrogates of their own: a family name has one whoever bears it (of either
  gender in Latin script), a first name has one, a domain has one, a local part has one;
- it is written in the format of the mention (separators, capitals, title).
Collision checks: among all distinct parts of a kind in the corpus no two may share a surrogate, and
none may equal a part that occurs; wholes are then distinct too. Losers (all but the first by hash)
draw again with the next attempt number until none is left. From the third draw names get a second
part of as many keyed syllables as the draw number, so their space grows 64-fold a draw; letters grow
by a place a draw from draw ``ROOM`` on, digits later: nothing is left without a surrogate.

Scale: texts are scanned where they are; mentions are narrow rows; entities are aggregated before
they are compared, so one entity in a third of all texts is one row. Per text, mentions are
distinct strings. No Python.

Defined results: null text stays null, empty stays empty; a text without entities is unchanged.
Repeated rows give repeated results. Null ids are kept. Extra columns are ignored by the query
and kept by ``replace_entities``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.scratch import written

KEY = "surrogate-key-1"  # of the registered query; replace_entities asks for one
ROOM = 4  # from this draw on letters grow by one a draw; digits from twice as many
# Calling codes of two digits; 1 and 7 have one, all others three.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# Patterns by kind, in the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])(?!\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])"
             r"|(?<![A-Za-z0-9])\+(?=(?:[0-9][ .-]?){8,15}(?![0-9]))[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,7}(?![A-Za-z0-9])",
    "name_m": r"(?<![\p{L}])(?:Mr\.?|Herr|Señor|Sr\.|Monsieur|г-н) [\p{Lu}][\p{L}]+(?: [\p{Lu}][\p{L}]+)?",
    "name_f": r"(?<![\p{L}])(?:Mrs\.?|Ms\.?|Frau|Señora|Sra\.|Madame|Mme|г-жа) [\p{Lu}][\p{L}]+(?: [\p{Lu}][\p{L}]+)?",
}
ANY = "|".join(PATTERNS.values())

# Surrogate names: fixed values by gender and script.
FIRST = {"m": "Adam Boris Colin Daniel Emil Frank Georg Hugo Ivo Jonas Karl Leon Martin Nils Oskar Paul".split(),
         "f": "Anna Berta Clara Dora Emma Flora Greta Helena Ida Julia Klara Lena Marta Nora Olga Paula".split(),
         "m_cyr": "Антон Борис Виктор Глеб Денис Егор Захар Иван".split(),
         "f_cyr": "Анна Вера Галина Дарья Елена Жанна Зоя Инна".split()}
LAST = {"lat": "Abel Brandt Corbin Decker Ebner Falk Gerber Hansen Ibsen Jansen Keller Lindner Marsh Norden Olsen Perrin".split(),
        "m_cyr": "Абрамов Белов Волков Громов Дроздов Ершов Жуков Зайцев".split(),
        "f_cyr": "Абрамова Белова Волкова Громова Дроздова Ершова Жукова Зайцева".split()}
SYLLABLES = {"lat": [a + b for a in "b d f g k l m n p r s t v w z j".split() for b in "aeio"],
             "cyr": [a + b for a in "б в г д ж з к л м н п р с т ф х".split() for b in "аеио"]}


def kind_of(hit: Column) -> Column:
    out = F.lit("name_f")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(hit.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, hit: Column) -> Column:
    """What makes two mentions the same entity."""
    return F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).when(kind == "iban", F.regexp_replace(hit, " ", "")) \
        .when(kind.startswith("name"), F.regexp_replace(hit, r"^\S+ ", "")) \
        .when((kind == "phone") & hit.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(hit, "[^0-9]", ""))).otherwise(F.regexp_replace(hit, "[^0-9]", ""))


def parts(kind: Column, value: Column) -> Column:
    """(kind, value) of what gets a surrogate of its own: an address's local part and domain, a name's
    first and family name, else the entity itself."""
    gender = F.substring(kind, 6, 1)
    family = F.when(value.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("family_"), gender)).otherwise(F.lit("family"))
    pair = lambda k, v: F.struct(k.alias("pkind"), v.alias("pvalue"))
    last = pair(family, F.substring_index(value, " ", -1))
    return F.when(kind == "email", F.array(pair(F.lit("local"), F.substring_index(value, "@", 1)), pair(F.lit("domain"), F.substring_index(value, "@", -1)))) \
        .when(kind.startswith("name") & value.contains(" "), F.array(pair(F.concat(F.lit("first_"), gender), F.substring_index(value, " ", 1)), last)) \
        .when(kind.startswith("name"), F.array(last)).otherwise(F.array(pair(kind, value)))


def digest(*parts: Column) -> Column:
    """128 hex digits."""
    text = F.concat_ws("\u0001", *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("\u0001more")), 256))


def _number(d: Column, place: Column | int) -> Column:
    """Number 0..65535 from four hex digits of a digest, at a place 0..31 (round again beyond)."""
    at = (F.pmod(place if isinstance(place, Column) else F.lit(place), F.lit(32)) * 4 + 1).cast("int")
    return F.conv(F.substring(d, at, F.lit(4)), 16, 10).cast("int")


def reshape(value: Column, d: Column, keep: int = 0) -> Column:
    """Letters to letters of the same case and script, digits to digits, the rest unchanged; the
    first ``keep`` characters stay."""
    chars = F.split(value, "")

    def swap(c: Column, i: Column) -> Column:
        n = _number(d, i)
        # each round of 32 characters shifts by a number of its own
        n = n + F.floor(i / 32).cast("int") * (_number(d, i + 7) % 97)
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + n % 26)).when(c.rlike("[A-Z]"), F.char(65 + n % 26)).otherwise(c)

    return F.array_join(F.transform(chars, swap), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes a card number of ``payload`` and itself valid."""
    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.reverse(F.split(payload, "")), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of a bank account number (remainder by 97)."""
    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def surrogate(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of a part at attempt ``draw``. A space that is full grows: names by
    syllables, letters and digits by places."""
    d = digest(F.lit(key), kind, value, draw.cast("string"))
    more = lambda of, first: F.substring(reshape(F.lit(of * 8), digest(d, F.lit("room"))), F.lit(1), F.greatest(draw - first, F.lit(0)))
    letters, digits = more("aaaaaaaa", ROOM), more("00000000", 2 * ROOM)
    top = F.substring_index(value, ".", -1)
    domain = F.concat(reshape(F.substring(value, F.lit(1), F.length(value) - F.length(top) - 1), d), letters, F.lit("."), top)
    ip = F.concat_ws(".", *[(_number(d, i) % 254 + 1).cast("string") for i in range(4)])
    cyr = value.rlike(r"\p{IsCyrillic}")

    def name(latin: list[str], cyrillic: list[str]) -> Column:
        pick = lambda names, place: F.element_at(F.array(*[F.lit(x) for x in names]), (_number(d, place) % len(names) + 1).cast("int"))
        syllables = F.when(cyr, F.array(*[F.lit(x) for x in SYLLABLES["cyr"]])).otherwise(F.array(*[F.lit(x) for x in SYLLABLES["lat"]]))
        coined = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(draw, F.lit(1))), lambda i: F.element_at(syllables, (_number(d, i + 2) % 64 + 1).cast("int"))), ""))
        known = F.when(cyr, pick(cyrillic, 0)).otherwise(pick(latin, 0))
        return F.when(draw > 1, F.concat_ws("-", known, coined)).otherwise(known)  # more room with every draw

    code = F.when(~value.startswith("+"), F.lit(0)).when(F.substring(value, 2, 1).isin("1", "7"), F.lit(2)).when(F.substring(value, 2, 2).isin(*CALLING), F.lit(3)).otherwise(F.lit(4))
    phone = F.concat(F.substring(value, F.lit(1), code), reshape(F.substring(value, code + 1, F.length(value)), d), digits)
    payload = F.concat(reshape(F.substring(value, F.lit(1), F.length(value) - 1), d, 1), digits)
    account = F.concat(reshape(F.substring(value, F.lit(5), F.length(value)), d), digits)
    country = F.substring(value, 1, 2)
    return F.when(kind == "local", F.concat(reshape(value, d), letters)).when(kind == "domain", domain).when(kind == "ip", ip) \
        .when(kind == "family_m", name(LAST["lat"], LAST["m_cyr"])).when(kind.isin("family", "family_f"), name(LAST["lat"], LAST["f_cyr"])) \
        .when(kind == "first_m", name(FIRST["m"], FIRST["m_cyr"])).when(kind == "first_f", name(FIRST["f"], FIRST["f_cyr"])) \
        .when(kind == "iban", F.concat(country, iban_digits(country, account), account)).when(kind == "card", F.concat(payload, luhn_digit(payload))) \
        .when(kind == "phone", phone).otherwise(F.concat(reshape(value, d), digits))


def in_format(kind: Column, hit: Column, form: Column) -> Column:
    """A canonical surrogate written like the mention: its separators, capitals and title."""
    def fill(keep: str) -> Column:
        kept = F.split(hit, "")
        place = lambda i: F.length(F.regexp_replace(F.substring(hit, F.lit(1), (i + 1).cast("int")), keep, ""))
        body = F.array_join(F.transform(kept, lambda c, i: F.when(c.rlike(keep), c).otherwise(F.substring(form, place(i), F.lit(1)))), "")
        extra = F.substring(form, F.length(F.regexp_replace(hit, keep, "")) + 1, F.length(form))
        return F.concat(body, extra)

    form = F.when(kind == "phone", F.regexp_replace(form, "[^0-9]", "")).otherwise(form)

    upper = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(F.substring(hit, (i + 1).cast("int"), F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return F.when(kind == "email", upper).when(kind == "ip", form).when(kind.startswith("name"), F.concat_ws(" ", F.substring_index(hit, " ", 1), form)) \
        .when(kind == "iban", fill(" ")).otherwise(fill("[^0-9]"))


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _content, hit, kind, value): the distinct mentions of each text."""
    found = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_content"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).alias("hit"))
    found = found.distinct().withColumn("kind", kind_of(F.col("hit")))
    return written(found.withColumn("value", canonical(F.col("kind"), F.col("hit"))), "mentions")


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, form): every distinct entity with its collision-free surrogate. Parts draw until
    none shares its surrogate or equals a part that occurs; as parts are told apart, so are wholes."""
    entities = written(found.select("kind", "value").distinct(), "entities")
    named = entities.withColumn("p", parts(F.col("kind"), F.col("value")))
    every = written(named.select(F.explode("p").alias("p")).select("p.pkind", "p.pvalue").distinct(), "parts")
    todo, done, draw = every, None, 0
    while True:
        tried = todo.withColumn("form", surrogate(F.col("pkind"), F.col("pvalue"), F.lit(draw), key))
        rank = F.row_number().over(Window.partitionBy("pkind", "form").orderBy(F.xxhash64("pvalue"), "pvalue"))
        tried = tried.withColumn("rank", rank)
        taken = every.select(F.col("pkind").alias("k"), F.col("pvalue").alias("v"))
        if done is not None:
            taken = taken.unionByName(done.select(F.col("pkind").alias("k"), F.col("form").alias("v")))
        taken = taken.distinct().withColumn("used", F.lit(True))
        judged = tried.join(taken, (F.col("pkind") == F.col("k")) & (F.col("form") == F.col("v")), "left")
        judged = written(judged.select("pkind", "pvalue", "form", ((F.col("rank") == 1) & F.col("used").isNull()).alias("ok")), "surrogates")
        good = judged.where("ok").select("pkind", "pvalue", "form")
        done = good if done is None else done.unionByName(good)
        todo = judged.where("not ok").select("pkind", "pvalue")
        if todo.isEmpty():
            break
        draw += 1
        if draw % 8 == 0:
            done = written(done, "surrogates")
    forms = named.select("kind", "value", F.posexplode("p").alias("at", "p")).select("kind", "value", "at", "p.pkind", "p.pvalue").join(done, ["pkind", "pvalue"])
    whole = forms.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("at", "form"))).alias("f"))
    joined = lambda by: F.array_join(F.transform("f", lambda x: x["form"]), by)
    return whole.select("kind", "value", F.when(F.col("kind") == "email", joined("@")).otherwise(joined(" ")).alias("form"))


def replace_entities(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the surrogates in ``text``, and ``entities``: a map from each replaced
    mention to its kind. ``secret`` is the key on which all surrogates depend."""
    found = mentions(docs, key, text)
    table = surrogate_table(found, secret).select(F.col("kind").alias("k"), F.col("value").alias("v"), "form")
    placed = found.join(table, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
    placed = placed.withColumn("new", in_format(F.col("kind"), F.col("hit"), F.col("form")))
    per_text = placed.groupBy("_id", "_content").agg(F.map_from_entries(F.collect_list(F.struct("hit", "new"))).alias("_new"),
                                                     F.map_from_entries(F.collect_list(F.struct("hit", "kind"))).alias("entities"))
    per_text = per_text.withColumnRenamed("_id", "_key").withColumnRenamed("_content", "_hash")
    rows = docs.join(per_text, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_hash")), "left")
    hits, gaps = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), F.lit("")).otherwise(F.coalesce(F.element_at("_new", hit), hit))))
    return rows.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))).drop("_key", "_hash", "_new")


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    out = replace_entities(docs, KEY)
    kinds = F.coalesce(F.map_values("entities"), F.array().cast("array<string>"))
    count = lambda *names: F.size(F.filter(kinds, lambda k: k.isin(*names))).cast("long")
    return out.select("doc_id", count("email").alias("n_email"), count("phone").alias("n_phone"), count("ip").alias("n_ip"), count("card").alias("n_card"),
                      count("iban", "ssn").alias("n_account"), count("name_m", "name_f").alias("n_name"), "text")
