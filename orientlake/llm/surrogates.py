"""Personal data replaced by keyed surrogates of the same kind, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orientlake.llm.common import Scratch, keep_columns

# What each kind of personal data looks like; the first kind that fits a place wins.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[^\s\"']{6,}|(?<=token = \")[0-9A-Za-z_-]{16,}(?=\")",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\d-])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
}
# Titles and given names that tell a person, by gender; Latin and Cyrillic script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "г-н", "господин"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "г-жа", "госпожа"),
          "n": ("Dr", "Prof", "Professor", "Doctor", "Mx")}
GIVEN = {
    ("m", "latin"): ("Adam", "Albert", "Andreas", "Antonio", "Bruno", "Carlos", "Daniel", "David", "Diego", "Emil", "Felix", "Frank", "George", "Hugo",
                     "Ivan", "James", "John", "Jonas", "Jorge", "Karl", "Louis", "Lukas", "Marco", "Martin", "Michael", "Nicolas", "Oscar", "Paul", "Peter", "Robert",
                     "Simon", "Thomas", "Victor", "William"),
    ("f", "latin"): ("Alice", "Amelia", "Anna", "Beatriz", "Carla", "Charlotte", "Clara", "Elena", "Elisabeth", "Emma", "Eva", "Hannah", "Helen", "Ines",
                     "Isabel", "Jane", "Julia", "Katharina", "Laura", "Lucia", "Maria", "Marie", "Martha", "Mary", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Sofia",
                     "Susan", "Teresa", "Ursula", "Vera"),
    ("m", "cyrillic"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Михаил", "Николай", "Павел", "Сергей"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
}
# Surnames are built by rule: three syllables and an ending.
SYLLABLES = {"latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro",
                       "sa", "se", "ta", "te", "to", "va", "ve", "vo"),
             "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "до", "ка", "ко", "ла", "ле", "ма", "мо")}
ENDINGS = {("m", "latin"): ("n", "s", "rd", "ck"), ("f", "latin"): ("n", "s", "rd", "ck"), ("m", "cyrillic"): ("нов", "ров"), ("f", "cyrillic"): ("нова", "рова")}
_SAME_LENGTH = 4  # attempts after the first before surrogates get longer
_WORD = r"\p{Lu}[\p{L}'’-]+"
_MARK = r"(?<![\p{L}\p{N}])"


def _alternatives(words) -> str:
    return "|".join(sorted(set(words), key=lambda w: (-len(w), w)))


def _name_pattern() -> str:
    titles = _alternatives(t for group in TITLES.values() for t in group)
    given = _alternatives(n for group in GIVEN.values() for n in group)
    # a look at the first letter spares the list for most words
    return (f"{_MARK}(?=[\\p{{Lu}}гд])(?:{titles})\\.?[ ]{_WORD}(?:[ ]{_WORD})?(?![\\p{{L}}\\p{{N}}])"
            f"|{_MARK}(?=\\p{{Lu}})(?:{given})[ ]{_WORD}(?![\\p{{L}}\\p{{N}}])")


#: One pattern for all kinds, so that places never overlap.
ANY = "|".join(f"(?:{p})" for p in [*PATTERNS.values(), _name_pattern()])


def has_personal_data(text: str) -> Column:
    """Whether ``ANY`` fits somewhere; texts without any sign of it are told by cheaper tests."""
    sign = F.col(text).rlike("[0-9@]")
    for mark in ("AKIA", "password=", 'token = "'):
        sign = sign | F.col(text).contains(mark)
    return F.coalesce((sign | F.col(text).rlike(_name_pattern())) & F.col(text).rlike(ANY), F.lit(False))


def kind_of(found: Column) -> Column:
    """Kind of a place found by ``ANY``; what fits no other pattern as a whole is a name or a secret."""
    out = F.when(found.rlike(r"^[^\s]+@[^\s]+$"), F.lit("email"))
    out = out.when(found.rlike(r"^AKIA[A-Z0-9]{16}$"), F.lit("secret"))
    for kind in ("address", "card", "social", "phone"):
        out = out.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return out.when(found.rlike(f"^(?:{_name_pattern()})$"), F.lit("name")).otherwise(F.lit("secret"))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, f"^(?:{_alternatives(t for g in TITLES.values() for t in g)})\\.?[ ]", 0)


def identity_of(kind: Column, value: Column) -> Column:
    """What stays the same when a value is written another way: case of an address, marks between digits, a title before a name."""
    name = F.lower(F.substr(value, F.length(_title(value)) + 1))
    return F.when(kind == "email", F.lower(value)).when(kind.isin("card", "phone", "social"), F.regexp_replace(value, r"\D", "")).when(
        kind == "name", name).otherwise(value)


def _number(digest: Column, place: Column, most: int) -> Column:
    """A number under ``most`` from four hexadecimal digits of a digest."""
    return F.pmod(F.conv(F.substr(digest, place * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(most))


def _pick(words, digest: Column, place: int) -> Column:
    return F.element_at(F.lit(list(words)), _number(digest, F.lit(place), len(words)) + 1)


def _digest(secret: str, kind: Column, identity: Column, attempt: Column) -> Column:
    """512 keyed bits; long values get further blocks when they need them."""
    return F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, attempt.cast("string"), F.sha2(F.concat_ws("\x1f", identity, F.lit(secret)), 256)), 512)


def _like(value: Column, digest: Column) -> Column:
    """Every letter by a letter of its case, every digit by a digit, everything else as it is; an empty text stays empty."""
    chars = F.split(value, "")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.struct(
        F.element_at(chars, i).alias("c"), _number(F.concat(digest, F.sha2(F.concat(digest, (i / 32).cast("int").cast("string")), 512)), F.pmod(i, F.lit(32)), 65536).alias("r")))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def swap(p: Column) -> Column:
        pick = lambda s: F.substr(F.lit(s), F.pmod(p["r"], F.lit(len(s))) + 1, F.lit(1))
        return F.when(p["c"].rlike("^[a-z]$"), pick(lower)).when(p["c"].rlike("^[A-Z]$"), pick(upper)).when(p["c"].rlike("^[0-9]$"), pick(digits)).otherwise(p["c"])

    return F.array_join(F.transform(pieces, swap), "")


def _card(identity: Column, digest: Column) -> Column:
    """Sixteen digits of the same first digit; the check digit holds exactly when it held before."""
    def weight(digits: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), lambda s, i: s + F.when(
            i % 2 == 1, _cross(2 * F.substr(digits, i, F.lit(1)).cast("int"))).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))

    body = F.concat(F.substr(identity, F.lit(1), F.lit(1)), F.substr(_like(identity, digest), F.lit(2), F.lit(14)))
    right = F.pmod(-weight(F.concat(body, F.lit("0"))), F.lit(10))
    held = F.pmod(weight(identity), F.lit(10)) == 0
    return F.concat(body, F.when(held, right).otherwise(F.pmod(right + 1 + _number(digest, F.lit(31), 9), F.lit(10))).cast("string"))


def _cross(two: Column) -> Column:
    return F.when(two > 9, two - 9).otherwise(two)


def _female(value: Column) -> Column:
    """Gender of a name from its title or its given name: m, f, or n when nothing tells."""
    title = F.rtrim(F.regexp_replace(_title(value), r"\.", ""))
    first = F.regexp_extract(F.substr(value, F.length(_title(value)) + 1), r"^[^ ]+", 0)
    men = [n for (g, _), names in GIVEN.items() if g == "m" for n in names]
    women = [n for (g, _), names in GIVEN.items() if g == "f" for n in names]
    return F.when(title.isin(*TITLES["m"]), F.lit("m")).when(title.isin(*TITLES["f"]), F.lit("f")).when(first.isin(*men), F.lit("m")).when(
        first.isin(*women), F.lit("f")).otherwise(F.lit("n"))


def _name(gender: Column, script: Column, words: Column, digest: Column, longer: Column) -> Column:
    """Given name and surname, or a surname alone, of the same gender and script; ``longer`` more syllables in the surname."""
    places = F.slice(F.lit(list(range(7, 31))), F.lit(1), longer)
    out = None
    for s in ("latin", "cyrillic"):
        for g in ("m", "f"):
            more = F.array_join(F.transform(places, lambda i: F.element_at(F.lit(list(SYLLABLES[s])), _number(digest, i, len(SYLLABLES[s])) + 1)), "")
            surname = F.initcap(F.concat(*[_pick(SYLLABLES[s], digest, i) for i in (1, 2, 3)], more, _pick(ENDINGS[(g, s)], digest, 4)))
            full = F.when(words > 1, F.concat_ws(" ", _pick(GIVEN[(g, s)], digest, 5), surname)).otherwise(surname)
            even = _number(digest, F.lit(6), 2) == (0 if g == "m" else 1)
            fits = (script == s) & ((gender == g) | ((gender == "n") & even))
            out = F.when(fits, full) if out is None else out.when(fits, full)
    return F.lower(out)


def _surrogate(secret: str) -> Column:
    """The new identity for (kind, identity, attempt, gender, script, words).

    Attempts after ``_SAME_LENGTH`` are longer by one letter, digit or
    syllable each, except for kinds whose length is fixed and whose space is
    large (cards, network addresses, social security numbers, access keys).
    """
    longer = F.greatest(F.col("attempt") - _SAME_LENGTH, F.lit(0))
    kind, identity = F.col("kind"), F.col("identity")
    digest = _digest(secret, kind, identity, F.col("attempt"))
    at = F.instr(identity, "@")
    host = F.substr(identity, at + 1)
    top = F.regexp_extract(host, r"(\.[^.]+)$", 1)
    # what is left of a host of the reserved example domains, and the top domain of any other
    kept = F.greatest(F.length(top), F.length(F.regexp_extract(host, r"((?:^|\.)example\.[a-z]+)$", 1)))
    email = F.concat(_like(F.concat(F.substr(identity, F.lit(1), at - 1), F.repeat(F.lit("x"), longer)), digest), F.lit("@"),
                     _like(F.substr(host, F.lit(1), F.length(host) - kept), F.reverse(digest)), F.substr(host, F.length(host) - kept + 1))
    abroad = F.greatest(F.length(identity) - 10, F.lit(0))  # the country code stays
    phone = F.concat(F.substr(identity, F.lit(1), abroad), _like(F.concat(F.substr(identity, abroad + 1), F.repeat(F.lit("0"), longer)), digest))
    octets = F.array_join(F.array(*[(_number(digest, F.lit(i), 223 if i == 0 else 254) + 1).cast("string") for i in range(4)]), ".")
    return F.when(kind == "email", email).when(kind == "address", octets).when(kind == "card", _card(identity, digest)).when(
        kind == "phone", phone).when(kind == "name", _name(F.col("gender"), F.col("script"), F.col("words"), digest, longer)).when(
        kind == "secret", F.when(identity.startswith("AKIA"), F.concat(F.lit("AKIA"), _like(F.substr(identity, F.lit(5)), digest))).otherwise(
            F.concat(F.when(identity.rlike("^[0-9a-f]+$"), F.substr(F.concat(digest, F.sha2(digest, 512)), F.lit(1), F.length(identity))).otherwise(_like(identity, digest)),
                     _like(F.repeat(F.lit("x"), longer), F.reverse(digest))))).otherwise(
        _like(identity, digest))


def written_like(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the way the value was written: its marks between digits, its case, its title. What is longer goes to the end."""
    size = F.length(value)
    places = F.sequence(F.lit(1), size)
    digits = F.array_join(F.transform(places, lambda i: F.when(F.substr(value, i, F.lit(1)).rlike(r"^\d$"), F.substr(
        surrogate, F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"\D", "")), F.lit(1))).otherwise(F.substr(value, i, F.lit(1)))), "")
    cased = F.array_join(F.transform(places, lambda i: F.when(F.substr(value, i, F.lit(1)).rlike("^[A-Z]$"), F.upper(F.substr(surrogate, i, F.lit(1)))).otherwise(
        F.substr(surrogate, i, F.lit(1)))), "")
    name = F.substr(value, F.length(_title(value)) + 1)
    plain = F.when(name == F.upper(name), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    digits = F.concat(digits, F.substr(surrogate, F.length(F.regexp_replace(value, r"\D", "")) + 1))
    cased = F.concat(cased, F.substr(surrogate, size + 1))
    return F.when(kind.isin("card", "phone", "social"), digits).when(kind == "email", cased).when(kind == "name", F.concat(_title(value), plain)).otherwise(surrogate)


def assign_surrogates(found: DataFrame, secret: str, scratch: Scratch, most_rounds: int = 30) -> DataFrame:
    """``(kind, identity, surrogate)`` for every identity; no two share a surrogate and none is somebody's real identity.

    ``found`` has (kind, value). In each round the identities without a
    surrogate make a proposal; one whose proposal is taken, is proposed by a
    smaller identity as well, or occurs in the corpus tries again, later
    with a longer surrogate, so that there is room for all.
    """
    value = F.col("value")
    tagged = found.select("kind", "value").distinct().select(
        "kind", identity_of(F.col("kind"), value).alias("identity"), _female(value).alias("gender"),
        F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin")).alias("script"),
        F.size(F.split(F.trim(identity_of(F.col("kind"), value)), " ")).alias("words"))
    # one identity may be written with and without a title; the telling gender wins
    known = scratch.cut(tagged.groupBy("kind", "identity").agg(F.min("gender").alias("gender"), F.min("script").alias("script"), F.max("words").alias("words")), "identities")
    open_ = known.withColumn("attempt", F.lit(0))
    given = None
    for turn in range(most_rounds):
        offered = open_.withColumn("surrogate", _surrogate(secret))
        real = known.select("kind", F.col("identity").alias("surrogate"))
        taken = real if given is None else real.union(given.select("kind", "surrogate"))
        first = offered.groupBy("kind", "surrogate").agg(F.min("identity").alias("identity")).join(taken, ["kind", "surrogate"], "left_anti")
        now = scratch.cut(first.select("kind", "identity", "surrogate"), "given")
        given = now if given is None else given.union(now)
        open_ = scratch.cut(open_.join(now.select("kind", "identity"), ["kind", "identity"], "left_anti").withColumn("attempt", F.lit(turn + 1)), "open")
        if not open_.take(1):
            return given
    raise ValueError("some values have no free surrogate of their form")


def replace_personal_data(texts: DataFrame, key: str = "file", text: str = "value", secret: str = "orientlake") -> DataFrame:
    """Whole texts with personal data replaced: ``key``, ``text``, ``n_replaced`` and ``kinds``.

    Takes run logs (``file``, ``value``), whose lines name people, mail and
    network addresses, or any table with a key and a text. E-mail addresses,
    network addresses, phone, card and social security numbers, names with a
    title or a known given name, and credentials get surrogates of their own
    kind: same gender and script of a name, same marks between digits, same
    case, valid check digits where they were valid.

    The surrogate depends on ``secret`` and the identity alone, so one
    identity has one surrogate everywhere, however it is written; collisions
    are checked over the whole corpus and tried again, so different
    identities stay different. Text without personal data comes back
    unchanged, null as null with 0. Null keys and repeated rows are treated
    like any row. No rows: an empty result.

    Texts are cut at the places found, places are looked up by their value,
    and the pieces are joined again in order; only texts with places take
    part in the look-up. A value that fills a third of all places is one row
    on one side of that join and can be split on the other.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    rows = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = scratch.cut(rows.where(has_personal_data("text")).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "places", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), "marked")
    places = scratch.cut(marked.select("row", F.posexplode("places").alias("at", "value")).withColumn("kind", kind_of(F.col("value"))), "places")
    given = assign_surrogates(places, secret, scratch)
    values = places.select("kind", "value").distinct().withColumn("identity", identity_of(F.col("kind"), F.col("value")))
    written = scratch.cut(values.join(given, ["kind", "identity"]).select("kind", "value", written_like(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")), "written")
    # the places of one text, as many as it holds
    lists = places.join(written, ["kind", "value"]).groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda s: s["new"]).alias("news"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    between = F.split("text", ANY, -1)
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("between"), F.col("news")), lambda s: F.array(s["between"], F.coalesce(s["news"], F.lit(""))))), "")
    changed = marked.join(lists, "row").select(F.col("key").alias(key), woven.alias(text), F.size("news").cast("bigint").alias("n_replaced"), "kinds")
    same = rows.where(~has_personal_data("text")).select(
        F.col("key").alias(key), F.col("text").alias(text), F.lit(0).cast("bigint").alias("n_replaced"), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)
