"""PII replacement by keyed surrogates. DataFrame functions only.

One pattern finds e-mail addresses, access keys, passwords and tokens, IBANs,
card, social security, telephone and IP numbers, and names after a title. Each
finding gets a surrogate of its own type: a keyed hash of the normal form of
the entity (an address in lower case, the digits of a number, the name without
its title) chooses letters and digits in place of those there, of the same
script, case and length. So the same entity has the same surrogate in every
document and every spelling of its marks, without a table of entities. Card
numbers keep their first digit and pass the checksum, IBANs keep their country
and pass theirs, IP numbers go to 10.0.0.0/8 as long as it has room, e-mail hosts keep their last
label; names get syllables of their script with an ending that fits the
title's gender.

Collisions are checked over the whole corpus: of two entities of a type with
one surrogate, and of any entity whose surrogate, as it would be written, is
another's real value (or its own), all but the first are hashed anew with the
next attempt number, until none is left. So that this ends, what has too few
other forms of its own (no letters or digits, or hardly any: `--------`, `-@-.-`,
`a@b.c`) gets more letters from the second attempt on, and other secrets, e-mail
addresses and names from attempt ROOMY on. Only these exceptions are a table; it
is joined to the findings, so that entities stay distinct. It is broadcast if
it has at most MAX_BROADCAST rows, else joined by a shuffle.

A last name that stands again in the same text without a title becomes the
last name of its surrogate.

Edge cases. Null text stays null, empty text empty. Text without findings is
unchanged, to the last character. Of findings that overlap the first and, of
those, the first type counts. Repeated rows get equal results. A null id
is an id like any other. An empty table gives an empty table. Further columns
pass through, whatever they are called. A surrogate is not an entity of this
corpus, so a second run with another key changes it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, join_unique, quoted, row_count, settle

MAX_BROADCAST = 20_000
MAX_ATTEMPTS = 64
#: Attempts after which secrets, e-mail addresses and names get longer. Fewer letters and digits than POOR are too few to choose from.
ROOMY, POOR = 8, 4

# Titles and their gender.
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Sir", "Mister"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "Madam"]
NEUTRAL = ["Dr", "Prof"]

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
_BLANK = r"[ \t\u00A0]{1,4}"
# Particles of names.
_PARTICLE = "(?:von|van|vom|de|der|den|del|della|di|da|dos|du|la|le|ten|ter|zu|zum|zur|af|av|bin|ibn|al|el)"
_WORD_OF_NAME = r"\p{Lu}[\p{L}'’]{1,30}"
# A name, initials with their points among them; the next person's title is none.
_NAME = rf"(?!{_TITLE}(?!\p{{L}}))(?:{_WORD_OF_NAME}|\p{{Lu}}\.(?:\p{{Lu}}\.){{0,3}})"
_NAMES = rf"(?:{_PARTICLE}{_BLANK}){{0,3}}{_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"""(?i:password|passwd|pwd|secret|token|api_key|apikey)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""
# Letters of scripts that put spaces between words; where none are, a local part of other letters has no beginning.
_SPACELESS = r"&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_WIDE = r"\p{L}\p{M}0-9._%+\-" + _SPACELESS
_HOST = r"\p{L}\p{M}0-9\-" + _SPACELESS
#: The types and what they look like; where several fit, the first counts. Each tells by its first sign where it cannot be.
PATTERNS = {
    "email": rf"(?:(?<![{_WIDE}])[{_WIDE}]{{1,64}}+|(?<=[^\x00-\x7F])[A-Za-z0-9._%+\-]{{1,64}}+)@[{_HOST}]{{1,63}}(?:\.[{_HOST}]{{1,63}}){{1,8}}",
    "access_key": r"(?:AKIA|ASIA)(?<![A-Za-z0-9].{4})[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": _LABEL + r"[A-Za-z0-9_+/=\-]{8,}+",
    "iban": r"[A-Z](?<![A-Za-z0-9].)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?=[0-9])(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ssn": r"\d(?<![\w\-].)\d{2}-\d{2}-\d{4}(?![\w\-])",
    "card": r"\d(?<![\w\-].)(?:[ \-]?\d){12,18}(?![\w\-])",
    "phone": r"(?=[0-9+(])(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?|\d{1,3}[ .\-])?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w\-])|\+(?=(?:[ .()\-]{0,2}\d){8,15}(?![\w]))\d[\d .()\-]{6,18}\d|0\d(?:[ .]\d{2}){4}(?![\w\-]))",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}\d]){_TITLE}{_BLANK}{_NAMES}(?:(?:{_BLANK}|-){_NAMES}){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every finding holds one of these; texts without them are passed over by a single quick scan.
MAYBE = rf"[0-9@]|A(?:KIA|SIA)[A-Z]|[=:](?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)[\"' \t]{{0,4}}.)|(?=\p{{Lu}}){_TITLE}{_BLANK}(?:\p{{Lu}}|{_PARTICLE}{_BLANK})"

# Syllables of made-up names, and their endings by gender, for each script.
_SYLLABLES = {
    "latin": "ba da fa ga ka la ma na pa ra sa ta va za bel del fel gel kel lor mor nor por ren sen tor vin zan bri dri fri gri".split(),
    "cyrillic": "ба да ва га за ка ла ма на па ра са та фа бел дел вел гел лор мор нор пор рен сен тор вин зан бри дри фри гри кри".split(),
    "greek": "βα δα γα ζα κα λα μα να πα ρα σα τα φα βελ δελ γελ κελ λορ μορ νορ πορ ρεν σεν τορ βιν ζαν βρι δρι φρι γρι κρι θρι".split(),
}
_ENDINGS = {"latin": ("on", "ina", "el"), "cyrillic": ("ов", "ова", "ин"), "greek": ("ος", "α", "ης")}
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _kind(found: Column) -> Column:
    """The type of a finding, told from the finding alone."""
    is_ = lambda p: found.rlike(rf"\A(?:{p})\z")
    out = F.when(found.contains("@"), "email").when(is_(PATTERNS["access_key"]), "access_key").when(is_(PATTERNS["person"]), "person")
    for name in ("iban", "ip", "ssn", "card", "phone"):
        out = out.when(is_(PATTERNS[name]), name)
    return out.otherwise("secret")


_TITLE_FIRST = rf"\A({_TITLE}){_BLANK}"


def _normal(kind: Column, found: Column) -> Column:
    """The form in which two findings are the same entity."""
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind.isin("card", "ssn"), F.regexp_replace(found, r"\D", ""))
        .when(kind == "phone", F.regexp_extract(F.regexp_replace(found, r"\D", ""), r"(\d{1,10})\z", 1))  # without the country's code
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(found, rf"\A{_LABEL}", ""))
        .when(kind == "person", F.regexp_replace(F.regexp_replace(found, _TITLE_FIRST, ""), _BLANK, " "))
        .otherwise(found)
    )


def _gender(found: Column) -> Column:
    title = F.rtrim(F.regexp_extract(found, _TITLE_FIRST, 1), F.lit("."))
    return F.when(title.isin(MALE), 1).when(title.isin(FEMALE), 2).otherwise(3)


def _hash(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    base = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value)
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(base, F.lit("\x1f2")), 256))


def _number(digest: Column, i: Column | int, width: int = 2) -> Column:
    """The i-th number below 16^width of a digest."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(128 // width)) * width + 1
    return F.conv(F.substring(digest, at, F.lit(width)), 16, 10).cast("int")


def _redraw(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """value with each letter and digit replaced by another of its script, case and kind."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        out = F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))).when(c.rlike(r"\A[0-9]\z"), (n % 10).cast("string"))
        for letters in _ALPHABETS:
            size = len(letters)
            out = out.when(F.contains(F.lit(letters), c), F.substring(F.lit(letters), n % size + 1, F.lit(1)))
            out = out.when(F.contains(F.lit(letters.upper()), c), F.substring(F.lit(letters.upper()), n % size + 1, F.lit(1)))
        latin = F.substring(F.lit(_ALPHABETS[0]), n % 26 + 1, F.lit(1))
        return out.when(c.rlike(r"\p{Lu}"), F.upper(latin)).when(c.rlike(r"[\p{L}\p{M}]"), latin).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _checked_card(value: Column) -> Column:
    """value with its last digit set so that the Luhn sum is right."""
    body = F.reverse(F.split(F.substring(value, F.lit(1), F.length(value) - 1), ""))
    part = F.transform(body, lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(part, F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _checked_iban(value: Column) -> Column:
    """value with its check digits (third and fourth sign) set right, the remainder taken sign by sign."""
    country, body = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    digits = F.array_join(F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    left = F.aggregate(F.split(digits, ""), F.lit(0), lambda s, c: F.pmod(s * 10 + c.cast("int"), F.lit(97)))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), body)


_SCRIPTS = (("cyrillic", r"[Ѐ-ӿ]"), ("greek", r"[Ͱ-Ͽ]"), ("latin", ""))


def _by_script(word: Column, of: Callable[[str], Column]) -> Column:
    return F.when(word.rlike(_SCRIPTS[0][1]), of("cyrillic")).when(word.rlike(_SCRIPTS[1][1]), of("greek")).otherwise(of("latin"))


def _made_up_name(key: str, value: Column, attempt: Column) -> Column:
    """The stems of as many made-up names; each hangs on its word alone, so that a surname stays one through a family."""

    def one(word: Column) -> Column:
        digest = _hash(key, F.lit("name"), word, attempt)
        pick = lambda k, s: F.element_at(F.lit(_SYLLABLES[s]), _number(digest, k) % 32 + 1)
        longer = lambda s: F.when(attempt >= ROOMY, F.concat(*(pick(k, s) for k in range(4, 8)))).otherwise("")
        return F.initcap(_by_script(word, lambda s: F.concat(*(pick(k, s) for k in range(4)), longer(s))))

    return F.array_join(F.transform(F.split(value, r"[ \-]"), one), " ")


def _ended_name(found: Column, stems: Column) -> Column:
    """Title and name: given names end as the title's gender asks, the last name ends alike for all."""
    words = F.split(stems, " ")
    ended = F.transform(
        words,
        lambda w, i: F.concat(w, _by_script(w, lambda s: F.element_at(F.lit(list(_ENDINGS[s])), F.when(i + 1 < F.size(words), _gender(found)).otherwise(3)))),
    )
    return F.concat(F.regexp_extract(found, _TITLE_FIRST, 0), F.array_join(ended, " "))


def _written(kind: Column, made: Column) -> Column:
    """All forms in which a surrogate may stand in a text, in normal form: names with the endings of each gender."""
    names = [_ended_name(F.lit(f"{title} "), made) for title in (MALE[0], FEMALE[0], NEUTRAL[0])]
    return F.when(kind == "person", F.transform(F.array(*names), lambda n: F.regexp_replace(n, _TITLE_FIRST, ""))).otherwise(F.array(made))


def _room(part: Column, digest: Column, attempt: Column) -> Column:
    """Letters behind a redrawn part, with each attempt one more, where it alone could not become another."""
    few = F.regexp_count(part, F.lit(r"[\p{L}\p{M}0-9]")) < POOR
    letters = F.translate(F.substring(digest, F.lit(65), attempt + 2), "0123456789", "ghijklmnop")
    return F.when((attempt >= ROOMY) | (attempt > 0) & few, letters).otherwise("")


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of an entity in normal form."""
    digest = _hash(key, kind, value, attempt)
    never = F.lit(False)
    local, host, top = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1), F.substring_index(value, ".", -1)
    host = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    # one host, one surrogate host, whoever writes from there
    hosts = _redraw(host, _hash(key, F.lit("host"), host, F.lit(0)), never)
    octet = lambda i: (_number(digest, i) % 256).cast("string")
    # private addresses; if many collide, reserved ones, then any
    first = F.when(attempt < 8, "10").when(attempt < 24, (_number(digest, 3) % 15 + 240).cast("string")).otherwise((_number(digest, 3) % 213 + 11).cast("string"))
    redrawn = _redraw(value, digest, F.when(kind == "secret", value.rlike(r"\A[0-9a-f]+\z")).otherwise(never))
    lead = lambda keep: F.concat(F.substring(value, 1, keep), F.substring(redrawn, F.lit(keep + 1), F.length(value)))
    # numbers begin with no 0, so that their length shows
    firm = F.concat((_number(digest, 31) % 8 + 2).cast("string"), F.substring(redrawn, F.lit(2), F.length(redrawn)))
    return (
        F.when(kind == "email", F.concat(_redraw(local, digest, never), _room(local, digest, attempt), F.lit("@"), hosts, top))
        .when(kind == "access_key", lead(4))
        .when(kind == "iban", _checked_iban(lead(2)))
        .when(kind == "ip", F.concat(first, F.lit("."), octet(0), F.lit("."), octet(1), F.lit("."), octet(2)))
        .when(kind == "card", _checked_card(lead(1)))
        .when(kind.isin("phone", "ssn"), firm)
        .when(kind == "person", _made_up_name(key, value, attempt))
        .otherwise(F.concat(redrawn, F.when(kind == "secret", _room(value, digest, attempt)).otherwise("")))
    )


def _render(kind: Column, found: Column, made: Column) -> Column:
    """The surrogate in the spelling of the finding: its title, spaces, brackets and hyphens."""
    signs = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))
    chars = F.split(found, "")
    # the signs that count take those of the surrogate, the last the last; more of them, a country's code, stay
    spare = F.regexp_count(found, signs) - F.length(made)
    laid = F.aggregate(
        chars,
        F.struct((1 - spare).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(F.regexp_like(c, signs), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.when(s["i"] > 0, F.substring(made, s["i"], F.lit(1))).otherwise(c)).alias("out"))).otherwise(
            F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))
        ),
        lambda s: s["out"],
    )
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), laid)
        .when(kind == "person", _ended_name(found, made))
        .when(kind == "secret", F.concat(F.regexp_extract(found, rf"\A{_LABEL}", 0), made))
        .when((kind == "email") & (found == F.upper(found)), F.upper(made))
        .otherwise(made)
    )


def findings(text_col: str) -> Column:
    """All findings of a text in order, repeats included; null for null."""
    text = F.col(text_col)
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, value: the different entities of all texts."""
    found = docs.select(F.explode(F.array_distinct(findings(text_col))).alias("f"))
    found = found.withColumn("kind", _kind(F.col("f")))
    return found.select("kind", _normal(F.col("kind"), F.col("f")).alias("value")).distinct()


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """kind, value, attempt: the entities whose first surrogate would be another's, or a real value. known should be settled."""
    made = lambda attempt: surrogate(key, F.col("kind"), F.col("value"), attempt)
    now = settle(known.select("kind", "value", F.lit(0).alias("attempt"), made(F.lit(0)).alias("s")))
    real = known.select("kind", F.col("value").alias("s"))
    for _ in range(MAX_ATTEMPTS):
        order = F.struct("attempt", "value")
        twice = now.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
        worse = now.join(twice, ["kind", "s"]).where(order != F.col("first")).select("kind", "value")
        forms = now.select("kind", "value", F.explode(_written(F.col("kind"), F.col("s"))).alias("s"))
        clash = settle(worse.union(forms.join(real, ["kind", "s"], "left_semi").select("kind", "value")).distinct())
        if not clash.count():
            break
        moved = now.join(clash.withColumn("clash", F.lit(1)), ["kind", "value"], "left")
        moved = moved.select("kind", "value", (F.col("attempt") + F.coalesce("clash", F.lit(0))).alias("attempt"), F.col("s").alias("old"), "clash")
        now = settle(moved.select("kind", "value", "attempt", F.when(F.col("clash").isNull(), F.col("old")).otherwise(made(F.col("attempt"))).alias("s")))
    else:
        raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts; a type has too few of them for its entities")
    return settle(now.where("attempt > 0").select("kind", "value", "attempt"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs with surrogates in text_col; with report, also n_replaced (bigint)."""
    odd = exceptions(settle(entities(docs, text_col)), key)
    found, tries, own_id, own_th = free_names(docs, 4)
    keyed = docs.withColumn(found, findings(text_col))
    if row_count(odd):
        spoken = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.explode(F.array_distinct(findings(text_col))).alias("f"))
        spoken = spoken.withColumn("kind", _kind(F.col("f"))).withColumn("k", F.concat_ws("\x1f", "kind", _normal(F.col("kind"), F.col("f"))))
        named = odd.select(F.concat_ws("\x1f", "kind", "value").alias("k"), "attempt")
        met = spoken.join(F.broadcast(named), "k") if row_count(odd) <= MAX_BROADCAST else join_unique(settle(spoken), named, "k")
        per_doc = settle(met.groupBy("id", "th").agg(F.map_from_entries(F.collect_set(F.struct("k", "attempt"))).alias("tries")))  # a text's own findings
        few = row_count(per_doc) <= MAX_BROADCAST
        per_doc = per_doc.toDF(own_id, own_th, tries)
        keyed = keyed.join(F.broadcast(per_doc) if few else per_doc, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_th)), "left")
    else:
        keyed = keyed.withColumn(tries, F.lit(None).cast("map<string,int>"))

    def one(f: Column) -> Column:
        # each step is worked out once and handed on
        kinds = F.transform(F.array(f), lambda x: F.struct(x.alias("f"), _kind(x).alias("kind")))
        values = F.transform(kinds, lambda x: F.struct(x["f"].alias("f"), x["kind"].alias("kind"), _normal(x["kind"], x["f"]).alias("value")))
        attempt = lambda x: F.coalesce(F.try_element_at(tries, F.concat_ws("\x1f", x["kind"], x["value"])), F.lit(0))
        made = F.transform(values, lambda x: F.struct(x["f"].alias("f"), x["kind"].alias("kind"), surrogate(key, x["kind"], x["value"], attempt(x)).alias("made")))
        return F.element_at(F.transform(made, lambda x: F.struct(_render(x["kind"], x["f"], x["made"]).alias("new"), F.when(x["kind"] == "person", x["f"]).alias("name"))), 1)

    between = F.split(text_col, ANY, -1)
    # last names without their titles, in what stands between the findings
    last = lambda c: F.regexp_extract(c, rf"({_WORD_OF_NAME})\z", 1)
    spelt = lambda n: F.array(F.struct(last(n["name"]).alias("old"), last(n["new"]).alias("new")), F.struct(F.upper(last(n["name"])).alias("old"), F.upper(last(n["new"])).alias("new")))

    def bare(part: Column, pairs: Column) -> Column:
        here = lambda old: F.concat(F.lit(r"(?<![\p{L}\p{M}\d'’@._\-])"), old, F.lit(r"(?![\p{L}\p{M}\d@])"))
        return F.aggregate(pairs, part, lambda text, p: F.when(text.contains(p["old"]), F.regexp_replace(text, here(p["old"]), p["new"])).otherwise(text))

    def built(made: Column) -> Column:
        new = F.concat(F.transform(made, lambda n: n["new"]), F.array(F.lit("")))
        named = F.array_distinct(F.flatten(F.transform(F.filter(made, lambda n: n["name"].isNotNull() & (last(n["name"]) != "")), spelt)))

        def laid(pairs: Column) -> Column:
            parts = F.when(F.size(pairs) > 0, F.transform(between, lambda part: bare(part, pairs))).otherwise(between)
            return F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, b)), "")

        return F.element_at(F.transform(F.array(named), laid), 1)

    some = F.size(found) > 0
    text = F.element_at(F.transform(F.array(F.transform(found, one)), built), 1)
    out = keyed.withColumn(text_col, F.when(some, text).otherwise(F.col(text_col)))
    columns = quoted(docs.columns)
    if report:
        return out.select(*columns, F.coalesce(F.greatest(F.size(found), F.lit(0)), F.lit(0)).cast("long").alias("n_replaced"))
    return out.select(*columns)
