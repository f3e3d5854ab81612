"""Operator 1, PII: surrogate generation (native DataFrame operations only).

Entities are found by one pattern with a branch per type, in one pass over the
texts. Every distinct entity (type and normal form) of the whole table gets one
surrogate from a keyed hash, of the same type and format: mail addresses stay
mail addresses; phone numbers, cards, account numbers, network addresses, keys
and hex secrets keep their punctuation, length and character classes; letters
become other letters of their script and case; cards and account numbers keep
valid check digits.

Names are found after a title. Surname and first name are entities of their own,
so that "Mr John Smith", "Mr Smith" and "Dr Smith" stay one person. Script
follows the name, the gender of a first name the titles it stands after in the
whole table (neutral if these differ or tell none).

Collision checks: two entities of a type never share a surrogate and no
surrogate equals an entity of the table. Whoever collides is drawn again with
the next attempt number; later attempts draw from larger spaces (longer names,
wider address ranges, more digits), so that room is found. Equal entities get
equal surrogates everywhere, so coreference is kept.

Skew: entities are counted before they move; the rows of an entity with more
than ``HOT_SHARE`` of all mentions stay where they are and get its surrogate by broadcast.
Texts without entities are not shuffled.

Edge cases: a null text stays null and an empty one empty; null and repeated
ids pass through; long texts and long repetitions are searched whole (no branch
of the pattern recurses); an empty table gives an empty result; extra columns are kept, but for one called
n_entities, which is replaced (names used here begin with ``_pii_``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import discard, join_by_weight, materialise, table

#: Key of the query where the setting ``spark.palimpsest.pii.key`` gives none; a deployment sets its own.
KEY = "palimpsest-query-key"
#: Draws after which a type has no room left, which is an error.
ATTEMPTS = 200

_TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа"),
    "n": ("Dr", "Prof"),
}
#: First names by gender and script (Latin, Cyrillic, Greek).
_FIRST = {
    "ml": "Alan Bruno Carl David Emil Frank Georg Hugo Ivan Jonas Karl Liam Marco Nils Oscar Paul Quentin Ralf Simon Tomas".split(),
    "fl": "Anna Berta Clara Diana Elena Fiona Greta Helga Irene Julia Karin Laura Maria Nadia Olga Paula Rosa Sofia Tanja Ursula".split(),
    "nl": "Alex Andrea Casey Charlie Dana Eden Jamie Jordan Kim Lee Morgan Noel Robin Sam Sasha Taylor Toni Val Wren Yael".split(),
    "mc": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Олег".split(),
    "fc": "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split(),
    "nc": "Саша Женя Валя Шура Слава Тоня".split(),
    "mg": "Γιώργος Νίκος Πέτρος Κώστας Σπύρος Αλέξης".split(),
    "fg": "Μαρία Ελένη Άννα Σοφία Ειρήνη Δάφνη".split(),
    "ng": "Χάρις Φένια Ρένα Στάθη".split(),
}
#: Beginnings, middles and endings of surnames by script; Cyrillic endings by gender.
_LAST = {
    "l": ("Abel Brandt Castell Dorn Ebert Falk Garner Holm Ibsen Jansen Keller Lorenz Marten Nolan Ortner Perrin Quist Rainer Sander Tellier Ullman Varga Winter York Zeller Ashby Berger Corbin Dalton Ellery".split(), "al en er il on ur an el in or".split(), "berg dale field ford ham ley man mark ridge sen son stein ton vik wood by".split()),
    "mc": ("Абрам Бел Ворон Гром Данил Ерш Зим Иль Козл Лос Мороз Новик Орл Павл Рыб Сокол".split(), "ар ен ик ол ун ан".split(), "ов ин еев ский енко".split()),
    "fc": ("Абрам Бел Ворон Гром Данил Ерш Зим Иль Козл Лос Мороз Новик Орл Павл Рыб Сокол".split(), "ар ен ик ол ун ан".split(), "ова ина еева ская енко".split()),
    "g": ("Αλεξ Βλάχ Γεωργ Δημ Καρ Λαμπ Μαν Νικολ Παπ Σταυρ".split(), "αν ιδ ελ ορ ουλ".split(), "άκης ίδης όπουλος ίου άτος".split()),
}
#: Letters and digits by class: each is replaced by another one of its class.
_CLASSES = (
    ("[0-9]", "0123456789"), ("[A-Z]", "".join(map(chr, range(65, 91)))), ("[a-z]", "".join(map(chr, range(97, 123)))),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"), (r"\p{IsLatin}", "àáâäçèéêëìíîïñòóôöùúûü"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "".join(map(chr, range(0x410, 0x430)))), (r"\p{IsCyrillic}", "".join(map(chr, range(0x430, 0x450)))),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHebrew}", "".join(map(chr, range(0x5D0, 0x5EB)))), (r"\p{IsArabic}", "".join(map(chr, range(0x628, 0x63B)))), (r"\p{IsHan}", "".join(map(chr, range(0x4E00, 0x4E80)))),
    (r"\p{IsHiragana}", "".join(map(chr, range(0x3042, 0x3090)))), (r"\p{IsKatakana}", "".join(map(chr, range(0x30A2, 0x30F0)))), (r"\p{IsHangul}", "".join(map(chr, range(0xAC00, 0xAC80)))),
    (r"\p{L}", "".join(map(chr, range(97, 123)))), (r"\p{N}", "0123456789"),
)

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for group in _TITLES.values() for t in group)
_HOST = r"[\p{L}\p{N}-]++"
#: Type and pattern, the first that fits at a place wins. Repeated groups are possessive: they loop instead of recursing.
PATTERNS = (
    ("email", rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@(?:{_HOST}(?:\.{_HOST})++(?<=\p{{L}})|{_HOST}\.\p{{L}}{{2,}}+)"),
    ("secret", r"(?i:password|passwd|pwd|api_?key|secret|token)(?:\s?[=:]\s?)[\"']?[A-Za-z0-9+/_-]{8,}[\"']?"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d])(?:\d{4}[ -]?){3}\d{3,4}(?!\d)"),
    ("hex_secret", r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"),
)
_SPLIT = "(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
#: Fits wherever any of the patterns does, and costs little where none does.
_HINT = rf"[0-9@]|A[KS]IA|[=:]\s?[\"']?[A-Za-z0-9+/_-]{{8}}|(?<![\p{{L}}])(?:{_TITLE})\.? |[a-f]{{40}}"


def entity_type(entity: Column) -> Column:
    """Type of a string that matched the whole pattern."""
    out = None
    for name, pattern in PATTERNS:
        # the string alone lacks the surroundings that look-arounds need, which then hold trivially
        hit = entity.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("hex_secret")


def normal_form(entity: Column, kind: Column) -> Column:
    """What makes two spellings the same entity: case for addresses, punctuation for numbers."""
    digits = F.regexp_replace(entity, r"[ ()./-]", "")
    value = F.regexp_replace(entity, r"^\p{L}+_?\p{L}*\s?[=:]\s?", "")
    return (
        F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "iban", "ssn"), digits)
        .when(kind == "secret", F.regexp_replace(value, "[\"']", "")).otherwise(entity)
    )


def _digest(key: str, *parts: Column) -> Column:
    """A keyed hash as 64 hex digits: the secret goes first and last, with lengths that cannot be confused."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 256)


def _number(digest: Column, at: int) -> Column:
    """Seven hex digits of the digest as a number."""
    return F.conv(F.substring(digest, at, 7), 16, 10).cast("long")


def _stream(digest: Column, length: Column) -> Column:
    """Hex digits from a digest, at least ``length`` of them."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / 64).cast("int"))), F.lit(""), lambda a, k: F.concat(a, F.sha2(F.concat_ws(":", digest, k.cast("string")), 256)))


def _reshape(text: Column, stream: Column, keep: Column) -> Column:
    """Each letter and digit after the first ``keep`` characters replaced by another one of its class, the rest left; ``stream`` holds four hex digits for each."""
    pools = F.split(F.lit("|".join(pool for _, pool in _CLASSES)), r"\|")

    def tag(c: Column, k: Column) -> Column:
        of = reduce(lambda acc, n: F.when(c.rlike(f"^{_CLASSES[n][0]}$"), n).otherwise(acc), reversed(range(len(_CLASSES))), F.lit(-1))
        return F.struct(c.alias("c"), F.when(k < keep, F.lit(None)).otherwise(F.get(pools, of)).alias("pool"))

    def one(x: Column, k: Column) -> Column:
        # a step of 1 to len - 1 from where the character stands (anywhere, if it is not in the pool)
        n = F.conv(F.substring(stream, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
        size = F.length(x["pool"])
        return F.coalesce(F.substring(x["pool"], (F.instr(x["pool"], x["c"]) + n % (size - 1)) % size + 1, F.lit(1)), x["c"])

    return F.array_join(F.transform(F.transform(F.split(text, ""), tag), one), "")


def _hexed(text: Column, stream: Column) -> Column:
    """Lower-case hex digits replaced by hex digits, the rest left."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, k: F.when(c.rlike("^[0-9a-f]$"), F.substring(stream, k + 1, F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Check digit for a string of digits without one."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _iban(country: Column, rest: Column) -> Column:
    """Country, two valid check digits (ISO 7064, modulo 97), and the rest."""
    def add(acc: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(c == "", acc).otherwise((acc * F.when(value > 9, 100).otherwise(10) + value) % 97)

    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), add)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(names)), " "), (number % len(names) + 1).cast("int"))


def name_script(name: Column) -> Column:
    """l, c or g by the first letter of a name; other scripts are given Latin names."""
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "c").when(name.rlike(r"^\p{IsGreek}"), "g").otherwise("l")


def _first_name(cls: Column, digest: Column, attempt: int) -> Column:
    """Names of a class (gender and script), compounds of more of them in later attempts."""
    parts = [reduce(lambda acc, k, n=n: F.when(cls == k, _pick(_FIRST[k], _number(digest, 1 + 8 * n))).otherwise(acc), _FIRST, F.lit("Alex")) for n in range(min(1 + attempt // 3, 7))]
    return F.concat_ws("-", *parts)


def _last_name(cls: Column, digest: Column, attempt: int) -> Column:
    """A beginning, as many middles as the attempt's stage asks for, and an ending."""
    out = F.lit(None).cast("string")
    for k, (begin, middle, end) in _LAST.items():
        middles = [_pick(middle, _number(digest, 17 + 7 * n)) for n in range(min(attempt // 3, 6))]
        out = F.when(cls == k, F.concat(_pick(begin, _number(digest, 1)), *middles, _pick(end, _number(digest, 8)))).otherwise(out)
    return F.coalesce(out, F.lit("Falkton"))


def draw(todo: DataFrame, attempt: int, key: str, parts: int) -> DataFrame:
    """``new``, the normal form of a surrogate, for each kind, form and cls (the class of a name)."""
    kind, form, cls = (F.col(c) for c in ("kind", "form", "cls"))
    # no room at the entity's own length: a character more every eighth attempt
    longer = F.concat(form, F.lit("0" * max(0, (attempt - 8) // 8)))
    local, domain = (F.coalesce(F.get(F.split(form, "@"), F.lit(k)), F.lit("")) for k in (0, 1))
    host = F.regexp_replace(domain, r"\..*$", "")
    start = F.when(kind == "card", F.substring(longer, F.lit(1), F.greatest(F.length(longer) - 1, F.lit(0)))).when(kind == "email", local).otherwise(longer)
    keep = F.when(kind == "card", 1).when((kind == "phone") & form.startswith("+"), 2).when(kind.isin("iban", "access_key"), 4).otherwise(0)
    ready = todo.select("kind", "form", "cls", _digest(key, kind, form, F.lit(str(attempt))).alias("d"), _digest(key, F.lit("domain"), domain).alias("place"), start.alias("start"), keep.alias("keep"), host.alias("host"))
    ready = ready.select("*", _stream(F.col("d"), F.length("start") * 4).alias("stream"), _stream(F.col("place"), F.length("host") * 4).alias("host_stream"))
    # dealt by number, so that small shuffles are not merged into one task of long draws; the digests are computed before, once
    ready = ready.repartition(parts, "kind", "form")
    d = F.col("d")
    a, b, c, e = (_number(d, k) for k in (1, 8, 15, 22))
    ready = ready.withColumn("shaped", _reshape(F.col("start"), F.col("stream"), F.col("keep")))
    shaped = F.col("shaped")
    mail = F.concat(shaped, F.lit("."), F.substring(d, 40, 8), F.lit("@"), _reshape(F.col("host"), F.col("host_stream"), F.lit(0)), F.lit("-"), F.substring("place", 1, 8), F.lit(".example.org"))
    octet = lambda x, n, low=0: (x % n + low).cast("string")
    # private addresses first, then the reserved upper block, then any
    top = F.lit("10") if attempt < 6 else octet(e, 15, 240) if attempt < 12 else octet(e, 223, 1)
    new = (
        F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", top, octet(a, 256), octet(b, 256), octet(c, 256)))
        .when(kind == "card", F.concat(shaped, _luhn(shaped)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(shaped, 2, 20)))
        .when(kind == "iban", _iban(F.substring(form, 1, 2), F.substring(shaped, 5, 40)))
        .when(kind == "first", _first_name(cls, d, attempt)).when(kind == "last", _last_name(cls, d, attempt))
        .when((kind == "hex_secret") | ((kind == "secret") & form.rlike("^[0-9a-f]+$")), _hexed(F.col("start"), F.col("stream"))).otherwise(shaped)
    )
    return ready.select("kind", "form", "cls", new.alias("new"))


def render(kind: Column, entity: Column, new: Column) -> Column:
    """The surrogate in the spelling of the entity: its punctuation or quotes."""
    symbols = F.split(new, "")

    def walk(state: Column, c: Column) -> Column:
        take = c.rlike("^[A-Za-z0-9+]$")
        return F.struct(F.concat(state["out"], F.when(take, F.coalesce(F.get(symbols, state["k"]), F.lit(""))).otherwise(c)).alias("out"), (state["k"] + F.when(take, 1).otherwise(0)).alias("k"))

    spelled = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), walk)
    spelled = F.concat(spelled["out"], F.substring(new, spelled["k"] + 1, F.length(new)))
    before = F.regexp_extract(entity, r"^(\p{L}+_?\p{L}*\s?[=:]\s?[\"']?)", 1)
    after = F.regexp_extract(entity, r"([\"']?)$", 1)
    return F.when(kind.isin("phone", "card", "iban", "ssn"), spelled).when(kind == "secret", F.concat(before, new, after)).otherwise(new)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, form, new for distinct (kind, form, cls) rows, free of collisions.

    Each round settles those whose draw is neither an entity's form nor taken,
    the smallest form winning a tie; the rest draw again. Only the losers, an
    ever smaller table, go round. ``entities`` must be a table that can be read again.
    """
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = entities.select("kind", F.col("form").alias("new"), F.lit(True).alias("_real"))
    settled: DataFrame | None = None
    todo = entities.select("kind", "form", "cls")
    for attempt in range(ATTEMPTS):
        drawn = draw(todo, attempt, key, parts)
        first = F.row_number().over(Window.partitionBy("kind", "new").orderBy("form")) == 1
        marked = drawn.withColumn("_first", first).join(real, ["kind", "new"], "left")
        if settled is not None:
            marked = marked.join(settled.select("kind", "new", F.lit(True).alias("_taken")), ["kind", "new"], "left")
        else:
            marked = marked.withColumn("_taken", F.lit(None).cast("boolean"))
        marked = materialise(marked.select("kind", "form", "cls", "new", (F.col("_first") & F.col("_real").isNull() & F.col("_taken").isNull()).alias("_ok")), "surrogates")
        good = marked.where("_ok").select("kind", "form", "new")
        settled = good if settled is None else settled.unionByName(good)
        todo = marked.where("NOT _ok").select("kind", "form", "cls")
        if todo.isEmpty():
            return settled
    raise RuntimeError(f"no surrogates left after {ATTEMPTS} draws: {todo.first()}")


def _with_parts(entities: DataFrame) -> DataFrame:
    """entity, m to entity, m, kind, form (null for names), and for names title, gender, first (or null) and last."""
    entity = F.col("entity")
    out = entities.withColumn("kind", entity_type(entity)).withColumn("form", F.when(F.col("kind") != "name", normal_form(entity, F.col("kind"))))
    title = F.when(F.col("kind") == "name", F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1))
    words = F.split(F.substring(entity, F.length("title") + 1, F.length(entity)), " ")
    gender = reduce(lambda acc, g: F.when(F.col("title").rlike(rf"^(?:{'|'.join(_TITLES[g])})\.? "), g).otherwise(acc), _TITLES, F.lit("n"))
    return out.withColumn("title", title).withColumn("gender", gender).withColumn("last", F.element_at(words, -1)).withColumn("first", F.when(F.size(words) > 1, words[0]))


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """entity, m, new for distinct entities with their numbers of mentions m."""
    parts = materialise(_with_parts(entities), "entities")
    names = parts.where("kind = 'name'")
    one = lambda column: names.where(F.col(column).isNotNull()).groupBy(F.lit(column).alias("kind"), F.col(column).alias("form")).agg(F.min("gender").alias("low"), F.max("gender").alias("high"), F.max(F.when(F.col("gender") != "n", F.col("gender"))).alias("top"), F.min(F.when(F.col("gender") != "n", F.col("gender"))).alias("bottom"))
    # the gender that titles tell, if they do not differ
    gender = F.when(F.col("top") == F.col("bottom"), F.col("top")).otherwise("n")
    script = name_script(F.col("form"))
    # Cyrillic surnames show gender by their own ending
    ending = F.when(F.col("form").rlike("(?:ова|ева|ёва|ина|ая)$"), "f").otherwise("m")
    cls = F.when(F.col("kind") == "first", F.concat(gender, script)).when(script == "c", F.concat(ending, script)).otherwise(script)
    forms = one("first").unionByName(one("last")).withColumn("cls", cls).select("kind", "form", "cls")
    plain = parts.where("kind <> 'name'").select("kind", "form").distinct().withColumn("cls", F.lit(None).cast("string"))
    forms = materialise(plain.unionByName(forms), "forms")
    drawn = materialise(surrogate_table(forms, key), "drawn")
    of = lambda kind: drawn.where(F.col("kind") == kind).select(F.col("form").alias(kind), F.col("new").alias(f"new_{kind}"))
    people = names.join(of("last"), "last").join(of("first"), "first", "left").select("entity", "m", F.concat("title", F.concat_ws(" ", "new_first", "new_last")).alias("new"))
    others = parts.where("kind <> 'name'").join(drawn, ["kind", "form"]).select("entity", "m", render(F.col("kind"), F.col("entity"), F.col("new")).alias("new"))
    out = materialise(others.unionByName(people), "replacements")
    discard(parts, forms, drawn)
    return out


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities``, the number replaced."""
    # most texts hold none, which the cheap pattern tells
    found = F.when(F.col(text).rlike(_HINT), F.regexp_extract_all(F.col(text), F.lit(_SPLIT), 0))
    base = docs.drop("n_entities")
    all_ = materialise(base.withColumn("_pii_row", F.monotonically_increasing_id()).withColumn("_pii_all", F.coalesce(found, F.array().cast("array<string>"))), "found")
    hits = all_.where(F.size("_pii_all") > 0)
    spelled = hits.select("_pii_row", F.explode(F.array_distinct("_pii_all")).alias("entity"))
    new = replacements(spelled.groupBy("entity").agg(F.count(F.lit(1)).alias("m")), key)
    mapped = join_by_weight(spelled, new, ["entity"], "m")
    per_text = mapped.groupBy("_pii_row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("_pii_map"))
    pieces = F.split(F.col(text), _SPLIT, -1)
    news = F.concat(F.transform("_pii_all", lambda e: F.element_at("_pii_map", e)), F.array(F.lit("")))
    changed = hits.join(per_text, "_pii_row").withColumn(text, F.array_join(F.zip_with(pieces, news, lambda p, n: F.concat(p, n)), "")).withColumn("n_entities", F.size("_pii_all"))
    rest = all_.where(F.size("_pii_all") == 0).withColumn("n_entities", F.lit(0))
    columns = [*base.columns, "n_entities"]
    return changed.select(columns).unionByName(rest.select(columns))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data: doc_id, text, n_entities."""
    key = spark.conf.get("spark.palimpsest.pii.key", KEY)
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
