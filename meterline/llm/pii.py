"""Surrogates for personal data, in SQL functions only.

Detected entities are replaced by keyed surrogates of the same type and
format.  One canonical value has one surrogate in the whole corpus (mentions
stay coreferent, whatever their punctuation or case), and two values never
share one: the distinct values get candidates derived from the key, a
candidate that is another value's or that occurs as a real value is rejected,
and the losers draw again until none is left.

Types: email, phone, card, ip, ipv6, ssn, iban, secret, and person names, split
in given names (by gender) and family names, each in Latin, Cyrillic or Greek.
Digits stay digits, letters keep case and hex stays hex; cards keep their
first digit and whether they pass the Luhn check; phones keep layout and, after
"+" or "00", the whole country code, else the first digit; email addresses move
to reserved example domains, IPv6 to the documentation prefix, written in full;
names are drawn from lists of the same gender and script, lengthened by
syllables when a list is used up.  Initials are rotated in their alphabet by a
keyed step, one to one, as there are too few to avoid all real ones.

Distinct texts are rewritten once per text key.  Texts that cannot hold an
entity (a necessary-character test) are passed on without a shuffle.

Defined cases: null and empty texts stay as they are; texts, words, hosts and
digit runs may be of any length; repeated rows get the same result; an empty
table gives an empty one; all columns are passed on.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from meterline.llm.common import drop_stored, fresh, lower_ascii, stored, text_key

# Honorifics by gender, given names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof")
NAMES = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Pierre",
                     "Carlos", "Juan", "Luis", "Stefan", "Andreas", "Jean"),
    ("f", "latin"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Anna", "Sarah", "Ursula",
                     "Marie", "Carmen", "Isabel", "Lucía", "Monika", "Sophie", "Claire"),
    ("n", "latin"): ("Alex", "Robin", "Sam", "Jordan", "Taylor", "Kim", "Chris", "Sascha"),
    ("m", "cyrillic"): ("Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
    ("n", "greek"): ("Άγγελος", "Χάρις"),
    ("s", "latin"): ("Smith", "Miller", "Brown", "Weber", "Schmidt", "Fischer", "Martin", "Bernard", "Dubois",
                     "García", "López", "Torres", "Clark", "Lewis", "Walker", "Young"),
    ("s", "cyrillic"): ("Смирнов", "Кузнецов", "Попов", "Соколов", "Лебедев"),
    ("s", "greek"): ("Παπαδόπουλος", "Γεωργίου", "Νικολάου", "Ιωάννου"),
}
SYLLABLES = {"latin": ("an", "el", "or", "is", "en", "ar", "ul", "in"), "cyrillic": ("ан", "ел", "ор", "ин", "ев", "ич"),
             "greek": ("ας", "ης", "ος", "ιδ", "ακ", "ελ")}

# No pattern repeats a group without a bound: Java matches such groups by recursion,
# one level a repetition, while a repeated character class is a loop.
# With up to eight inner capitals: O'Brien, McDonald, Smith-Jones.
_WORD = r"\p{Lu}[\p{Ll}’'-]+(?:\p{Lu}(?=[\p{Ll}’'])[\p{Ll}’'-]+){0,8}"
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_INITIAL = "[" + "".join(ALPHABETS) + r"]\."
_TITLE = "(?:" + "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)) + r")\b\.?"
_GIVEN = "(?:" + "|".join(n for (g, _), names in NAMES.items() if g != "s" for n in names) + ")"
_KEYWORD = "(?i:password|passwd|pwd|token|secret|api[_-]?key)"
# No entity starts inside a run of ASCII letters and digits; this one test per
# character keeps the alternatives off most of a text.
_START = "(?<![A-Za-z0-9])"
# Names and titles start with one of these.
_CAPITAL = r"(?=[\p{Lu}г])"
_H = "[0-9A-Fa-f]{1,4}"
# After "+": country code, area or trunk digits in brackets, groups; 7 digits at least.
_ABROAD = r"(?<![+])\+(?=(?:[0-9][ .()-]{0,3}){7})[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\))?[ .-]?[0-9]{1,14}(?:[ .-][0-9]{2,8}){0,5}(?![0-9])"
_LOCAL = r"(?<![+])(?:1[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
# With the trunk digit 0: groups parted by one and the same sign, 8 digits at least, no date.
_TRUNK = (r"(?<![+.,])(?:(?!0[0-9](?<day>[ .-])[0-9]{2}\k<day>[0-9]{4}(?![0-9]))0[0-9]{1,5}(?<sep>[ .-])(?=(?:[0-9][ .-]?){6})[0-9]{2,8}(?:\k<sep>[0-9]{2,8}){0,4}"
          r"|\(0[0-9]{1,4}\) ?[0-9]{3,8}(?:[ .-][0-9]{2,5}){0,3})(?![0-9])")
_PLAIN = r"(?<![+.,])(?:[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{8,9})(?!\.?[0-9])"
# In order of precedence; the first alternative that matches at a place wins.
# A host has at most 127 labels, as in the domain name system.
PATTERNS = {
    "email": r"(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+",
    "secret": _KEYWORD + r"""["']? ?[=:] ?["']?[A-Za-z0-9+/_-]{8,}+|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])""",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![:.])(?=[A-Fa-f:]*[0-9])(?:{_H}(?::{_H}){{7}}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)"
            r"(?![A-Za-z0-9]|:[0-9A-Fa-f:]|\.[0-9])",
    # not a number with 00, a country code and a short group, which is a phone
    "card": r"(?!00[1-9][0-9]{1,2}(?<cut>[ -])[0-9]{2,3}(?:\k<cut>[0-9]{2,8}){1,3}(?![ -]?[0-9]))[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": f"{_ABROAD}|{_LOCAL}|{_TRUNK}|{_PLAIN}",
    "name": rf"{_CAPITAL}(?<!\p{{L}})(?:{_TITLE}(?: {_INITIAL}){{0,3}} {_WORD}(?:(?: {_INITIAL}){{0,3}} {_WORD})?"
            rf"|{_GIVEN}(?:-{_WORD})?(?: {_INITIAL}){{0,3}} {_WORD})(?!\p{{L}})",
}
ANY = _START + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
# Every pattern needs a match of this; a cheap test on whole texts.
MAY_HOLD = rf"""[0-9@]|{_START}(?:(?=[pPtTsSaA])(?:AKIA|{_KEYWORD}["']? ?[=:])|{_CAPITAL}(?:{_TITLE} |{_GIVEN}[ -]))"""
# E.164: no country code starts another.
_COUNTRY = r"^(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SECRET_HEAD = "^((?:" + _KEYWORD + r"""["']? ?[=:] ?["']?)|AKIA)"""


def _type(ent: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(ent.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _any_of(values) -> str:
    return "^(?:" + "|".join(values) + r")\.?$"


def _turned(initial: Column, key: str) -> Column:
    """Another initial of the same alphabet, by a keyed step."""
    step = int(hashlib.sha256(f"{key}\0initial".encode()).hexdigest(), 16)
    turn = lambda a: a[(n := 1 + step % (len(a) - 1)):] + a[:n]
    return F.translate(initial, "".join(ALPHABETS), "".join(map(turn, ALPHABETS)))


def _parts(ent: Column, kind: Column, key: str) -> Column:
    """(kind, head, value) of an occurrence: names are split in words, titles
    and initials have kind null and their written form as head; others are one part whose fixed head
    (the name of a secret) is kept."""
    words = F.split(ent, " ")
    known = lambda g: F.array(*[F.lit(n) for (x, _), ns in NAMES.items() if x == g for n in ns])
    given = lambda w: F.substring_index(w, "-", 1)
    title = words[0].rlike(_any_of((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)))
    gender = lambda w: (F.when(words[0].rlike(_any_of(MALE_TITLES)) | F.array_contains(known("m"), given(w)), "m")
                        .when(words[0].rlike(_any_of(FEMALE_TITLES)) | F.array_contains(known("f"), given(w)), "f").otherwise("n"))
    script = lambda w: (F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic")
                        .when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin"))
    part = lambda k, h, v: F.struct(k.alias("kind"), h.alias("head"), v.alias("value"))
    none = F.lit(None).cast("string")
    names = F.transform(words, lambda w, i: F.when((i == 0) & title, part(none, w, F.lit(""))).when(
        w.rlike(f"^{_INITIAL}$"), part(none, _turned(w, key), F.lit(""))).when(
        i == F.size(words) - 1, part(F.concat(F.lit("s-"), script(w)), F.lit(""), w))
        .otherwise(part(F.concat(gender(w), F.lit("-"), script(w)), F.lit(""), w)))
    head = F.when(kind == "secret", F.regexp_extract(ent, _SECRET_HEAD, 1)).otherwise("")
    return F.when(kind == "name", names).otherwise(F.array(part(kind, head, F.substr(ent, F.length(head) + 1))))


def _without_trunk(phone: Column) -> Column:
    """The "(0)" after a country code is no part of the number."""
    return F.when(phone.startswith("+"), F.replace(phone, F.lit("(0)"), F.lit("()"))).otherwise(phone)


def _full_ipv6(value: Column) -> Column:
    """All eight groups in four digits."""
    groups = lambda text: F.array_remove(F.split(text, ":"), "")
    left = groups(F.substring_index(value, "::", 1))
    right = F.when(F.contains(value, F.lit("::")), groups(F.substring_index(value, "::", -1))) \
        .otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def _canonical(kind: Column, value: Column) -> Column:
    """The same for every way of writing one entity."""
    return (F.when(kind == "email", lower_ascii(value))
            .when(kind == "phone", F.regexp_replace(_without_trunk(value), "(?!^[+])[^0-9]", ""))
            .when(kind == "ipv6", _full_ipv6(lower_ascii(value)))
            .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
            .otherwise(value))


def _pick(values, seed: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(seed, F.lit(len(values))).cast("int"))


def _syllable(script: str, draw, i: Column) -> Column:
    return _pick(SYLLABLES[script], draw(i))


def _seeds(key: str) -> dict[str, Column]:
    """Keyed seeds of an attempt at an entity and of the domain of an address."""
    told = F.concat_ws("\0", F.lit(key), "kind", "norm", F.col("attempt").cast("string"))
    domain = F.concat_ws("\0", F.lit(key), F.lit("domain"), F.substring_index("norm", "@", -1))
    return {"seed": F.sha2(told, 256), "domain_seed": F.sha2(domain, 256)}


def _candidate(kind: Column, norm: Column, attempt: Column, seed: Column, at: Column) -> Column:
    """The canonical surrogate that the key gives an entity at this attempt."""
    draw = lambda i: F.xxhash64(seed, i)
    digit = lambda i, lo=0: F.pmod(draw(i), F.lit(10 - lo)).cast("int") + lo
    letters = lambda alphabet, i: F.substr(F.lit(alphabet), F.pmod(draw(i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    hexa = norm.rlike("^[0-9a-f]+$")

    def shaped(text: Column, keep: int | Column) -> Column:
        """Every letter and digit redrawn in its class, the first ``keep`` kept."""
        one = lambda h, c, i: (F.when(i < keep, c)
                               .when(c.rlike("[0-9]"), digit(i).cast("string"))
                               .when(c.rlike("[a-z]"), F.when(h, letters("abcdef", i))
                                     .otherwise(letters("abcdefghijklmnopqrstuvwxyz", i)))
                               .when(c.rlike("[A-Z]"), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c))
        # the test of the whole value is made once, not at every character
        return F.get(F.transform(F.array(hexa), lambda h: F.array_join(F.transform(F.split(text, ""), partial(one, h)), "")), F.lit(0))

    longer = F.when(attempt >= 8, F.array_join(F.transform(  # formats with few values grow
        F.sequence(F.lit(1), attempt - 7), lambda i: digit(i + 1000).cast("string")), "")).otherwise("")
    local = F.substring_index(norm, "@", 1)
    host = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substr(
        F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64(at, i), F.lit(26)).cast("int") + 1, F.lit(1))), "")
    email = F.concat(shaped(local, 0), longer, F.lit("@"), host, F.lit(".example."),
                     _pick(("com", "net", "org"), F.xxhash64(at, F.lit(0))))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)),
                                  lambda i: (F.pmod(draw(i), F.lit(254)) + 1).cast("string")), ".")
    ipv6 = F.concat(F.lit("2001:0db8"), F.regexp_replace(F.substr(seed, F.lit(1), F.lit(24)), "(.{4})", ":$1"))
    code = F.greatest(F.lit(1), F.length(F.regexp_extract(norm, _COUNTRY, 0)))
    card = shaped(norm, 1)
    # the last digit makes the number pass the Luhn check, or fail it, as the original does
    def luhn(text: Column) -> Column:
        return F.aggregate(F.transform(F.reverse(F.split(text, "")), lambda c, i: F.when(
            i % 2 == 0, c.try_cast("int")).otherwise(F.pmod(c.try_cast("int") * 2, F.lit(10)) + F.floor(c.try_cast("int") / 5).cast("int"))),
            F.lit(0), lambda a, x: a + x)
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    check = F.pmod(10 - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    off = F.when(F.pmod(luhn(norm), F.lit(10)) == 0, 0).otherwise(digit(F.lit(99), 1))
    card = F.concat(body, F.pmod(check + off, F.lit(10)).cast("string"))
    out = (F.when(kind == "email", email).when(kind == "ip", F.concat(ip, longer))
           .when(kind == "card", F.concat(card, longer)).when(kind == "phone", F.concat(shaped(norm, code), longer))
           .when(kind == "ipv6", ipv6).when(kind == "iban", F.concat(shaped(norm, 2), longer)))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(attempt / 2).cast("int")))
    syllables = {s: F.array_join(F.transform(rounds, partial(_syllable, s, draw)), "") for s in SYLLABLES}
    for (g, script), names in NAMES.items():
        out = out.when(kind == f"{g}-{script}", F.concat(_pick(names, draw(F.lit(0))),
                                                         F.when(attempt >= 2, syllables[script]).otherwise("")))
    return out.otherwise(F.concat(shaped(norm, 0), longer))


def _rendered(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate's characters in the layout in which ``value`` is written."""
    written = value
    value = F.when(kind == "phone", _without_trunk(value)).otherwise(value)
    surrogate = F.when(kind == "phone", F.ltrim(surrogate, F.lit("+"))).otherwise(surrogate)
    layout = F.split(value, "")
    body = r"[A-Z0-9]"
    at = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    filled = F.array_join(F.transform(layout, lambda c, i: F.when(
        c.rlike(body), F.substr(surrogate, at(i), F.lit(1))).otherwise(c)), "")
    tail = F.substr(surrogate, F.length(F.regexp_replace(value, "[^A-Z0-9]", "")) + 1)
    filled = F.when((kind == "phone") & (written != value), F.replace(filled, F.lit("()"), F.lit("(0)"))).otherwise(filled)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(filled, tail)).otherwise(surrogate)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for the distinct (kind, norm) of ``entities``,
    one to one within a kind and disjoint from the values themselves.

    Of the entities that draw one candidate the one with the smallest keyed
    hash gets it; the others draw again, with the next attempt."""
    todo = stored(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    real, done, attempt = todo.select("kind", F.col("norm").alias("surrogate")), None, 0
    while True:
        drawn = todo.withColumns(_seeds(key)).select("kind", "norm", _candidate(
            *map(F.col, ("kind", "norm", "attempt", "seed", "domain_seed"))).alias("surrogate"))
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        rank = F.struct(F.xxhash64(F.lit(key), "kind", "norm").alias("h"), F.col("norm").alias("norm"))
        won = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate") \
            .agg(F.min(rank).alias("w")).select("kind", F.col("w.norm").alias("norm"), "surrogate")
        won = stored(won, "pii-surrogates")
        done = won if done is None else done.unionByName(won)
        left = stored(todo.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti")
                      .withColumn("attempt", F.lit(attempt + 1)), "pii-entities")
        if attempt:  # the first round's table is still read as ``real``
            drop_stored(todo)
        if left.isEmpty():
            return done
        todo, attempt = left, attempt + 1


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity of ``text_col`` replaced; all columns
    kept, plus ``n_entities`` (of the original text) under a name that is free."""
    (count,) = fresh(docs, "n_entities")
    th, sur, whole = "__text_key", "__surrogates", "__row"
    text = F.col(f"`{text_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), text.alias("__text"))
    may = packed.where(F.col("__text").rlike(MAY_HOLD)).withColumn(th, text_key(F.col("__text")))
    rest = packed.where(~F.coalesce(F.col("__text").rlike(MAY_HOLD), F.lit(False)))

    # the outer form: a filter on the array's size would match every text twice
    found = may.select(th, F.posexplode_outer(F.regexp_extract_all("__text", F.lit(ANY), F.lit(0))).alias("pos", "ent"))
    occurrences = found.where("pos is not null").select(th, "pos", "ent", _type(F.col("ent")).alias("kind"))
    # a text that occurs in many rows is kept once: its mentions are equal
    mentions = occurrences.select(th, "pos", F.posexplode(_parts(F.col("ent"), F.col("kind"), key)).alias("sub", "part")) \
        .select(th, "pos", "sub", "part.*").distinct()
    mentions = stored(mentions.withColumn("norm", _canonical(F.col("kind"), F.col("value"))), "pii-mentions")
    table = surrogates(mentions.where("kind is not null"), key)
    filled = mentions.join(table, ["kind", "norm"], "left").select(
        th, "pos", "sub", F.concat("head", F.coalesce(_rendered(F.col("kind"), F.col("value"), F.col("surrogate")),
                                                      F.lit(""))).alias("out"))
    per_ent = filled.groupBy(th, "pos").agg(F.sort_array(F.collect_list(F.struct("sub", "out"))).alias("o")) \
        .select(th, "pos", F.array_join("o.out", " ").alias("out"))
    per_text = stored(per_ent.groupBy(th).agg(F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("o"))
                      .select(th, F.col("o.out").alias(sur)), "pii-texts")
    joined = may.join(per_text, th, "left")
    pieces = F.zip_with(F.split("__text", ANY), F.concat(F.col(sur), F.array(F.lit(""))),
                        lambda a, b: F.concat(a, b))
    new = F.when(F.col(sur).isNull(), F.col("__text")).otherwise(F.array_join(pieces, ""))
    changed = joined.select(whole, new.alias("__new"), F.when(F.col(sur).isNull(), 0).otherwise(F.size(sur)).cast("long").alias("__n"))
    same = rest.select(whole, F.col("__text").alias("__new"), F.lit(0).cast("long").alias("__n"))
    cols = [F.col("__new").alias(c) if c == text_col else F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns]
    return changed.unionByName(same).select(*cols, F.col("__n").alias(count))
