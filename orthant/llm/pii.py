"""Surrogates for personal data. DataFrame functions only.

Detected: e-mail, IPv4 and IPv6 addresses, payment cards (13 to 19 digits, a card network's first digits and
a valid Luhn sum; inside a longer run of digits in a usual layout), bank accounts (IBAN with valid check
digits), phone numbers, secrets after a key word, and persons after a title; a name found so is replaced in
the rest of its text, too, wherever it stands as a word of its own. Every entity
is replaced by an invented one of its kind: keyed (SHA-256 with the caller's secret key), the same wherever
the entity occurs (coreference; "Mrs Ann Smith" and "Mrs Smith" share the family name), in the
entity's own layout: digits, case and signs stay where they are, cards keep network digit and
Luhn validity, accounts country and check digits, names gender (of the title) and script (Latin,
Cyrillic or Greek; names in other scripts become Latin).

Collision check: each distinct entity is given a candidate; a candidate that another entity already
has, that two entities want (the smaller one gets it) or that is itself an entity of the
corpus is refused, and the next attempt is drawn until none is left. So distinct entities stay
distinct and no surrogate is another one's real value.

Scale: texts are searched once, and what was found is written beside them. Distinct entities are aggregated
before they are shuffled; only texts with entities meet their surrogates by id.

Cases: null and empty texts come back as they are; repeated rows are treated alike; further
columns are never looked at by ``surrogates``. ``MAX_ATTEMPTS`` refused draws raise an error. A name without
a title is found only in a text that has it with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, plain_columns, shared_dir, text_hash

MAX_ATTEMPTS = 64
#: A sign that no character is, set around matches; texts that hold it all the same are split in two passes.
MARK = "\ufdd0"

# Titles before a person's name, by gender.
MALE = ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "Sir", "господин", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "госпожа", "Госпожа", "г-жа")

# Syllables of invented names.
LATIN = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te")
GREEK = ("βα", "βε", "βο", "δα", "δε", "δο", "φα", "φε", "γα", "γο", "θα", "θε", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε")
CYRILLIC = ("ба", "бе", "бо", "да", "де", "до", "фа", "фе", "га", "го", "ха", "хе", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те")

NAME = r"\p{Lu}[\p{L}'’-]+"
TITLE = r"(?:" + "|".join(sorted((*MALE, *FEMALE), key=lambda t: (-len(t), t))) + r")\.?"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
#: Where digits after a card's are something else: a phone number or an address.
ELSE = rf"(?!\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!\d)|(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))"
PATTERNS = {
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9+/_=-]{16,}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.[\p{L}]{2,}",
    "ip": r"(?<![\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|{_HEX}::)(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\p{L}\p{N}+])" + PHONE,
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])[2-6]\d(?:[ -]?\d){11}\d*+(?![\p{N}])(?:[ -]" + ELSE + r"\d++(?![\p{N}])){0,1000}+",
    "person": r"(?<![\p{L}])" + TITLE + r" " + NAME + r"(?: " + NAME + r")?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
HINT = r"[@\d]|(?<![\p{L}])" + TITLE + r" \p{Lu}|(?i:api.?key|access.?key|secret|token|passw|pwd)"
KINDS = tuple(PATTERNS)
#: What makes a number a card: first digits of a network.
NETWORK = r"^(?:4|5[1-5]|2[2-7]|3[04-9]|6)"
#: How a card is written inside a run of digits, the longest first; a whole run, its start and what follows
#: a card may have any groups.
LAYOUTS = tuple(rf"^({x})(?!\d)" for x in (r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}", r"\d{13,19}"))
ANY_GROUPS = r"^(\d(?:[ -]?\d){12,18})(?!\d)"


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _digit(s: Column, i: Column) -> Column:
    return F.ascii(F.substring(s, i, F.lit(1))) - 48


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits (0 modulo 10 if it is valid)."""
    n = F.length(digits)
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    value = lambda i: F.when((n - i) % 2 == 1, doubled(_digit(digits, i))).otherwise(_digit(digits, i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + value(i))


def is_card(raw: Column) -> Column:
    d = digits_of(raw)
    return d.rlike(NETWORK) & F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)


def mod_97(s: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number modulo 97."""
    place = F.when(s.isNotNull(), F.split(s, ""))
    step = lambda acc, c: F.when(c.rlike("[A-Z]"), acc * 100 + F.ascii(c) - 55).when(c == "", acc).otherwise(acc * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(place, F.lit(0), step)


def is_iban(raw: Column) -> Column:
    plain = F.replace(raw, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def kind_of(raw: Column) -> Column:
    """Which pattern a match is of, in the order of PATTERNS; null for a number that is no card."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        mine = raw.rlike(f"^(?:{pattern})$")
        valid = {"card": is_card, "iban": is_iban}.get(kind)
        out = F.when(mine & valid(raw) if valid else mine, kind).otherwise(out)
    return out


def cards_in(run: Column) -> Column:
    """A run of digits cut into (before, raw): its cards, each with what lies before it, and what is left
    at the end with an empty raw. At each group the first layout that holds a card is taken."""
    piece = "array<struct<before:string,raw:string>>"

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        tried = [F.regexp_extract(rest, x, 1) for x in LAYOUTS]
        tried.append(F.when(F.length(acc["before"]) < 2, F.regexp_extract(rest, ANY_GROUPS, 1)).otherwise(""))
        found = F.array_join(F.slice(F.filter(F.array(*tried), is_card), 1, 1), "")
        group = F.regexp_extract(rest, r"^\d*[ -]?", 0)
        after = F.substring(rest, F.length(found) + 1, F.length(rest))
        gap = F.regexp_extract(after, "^[ -]", 0)
        hit = F.struct(
            F.substring(after, F.length(gap) + 1, F.length(after)).alias("rest"), gap.alias("before"),
            F.concat(acc["out"], F.array(F.struct(acc["before"].alias("before"), found.alias("raw")))).alias("out"),
        )
        miss = F.struct(F.substring(rest, F.length(group) + 1, F.length(rest)).alias("rest"), F.concat(acc["before"], group).alias("before"), acc["out"].alias("out"))
        return F.when(F.length(found) > 0, hit).otherwise(miss)

    start = F.struct(run.alias("rest"), F.lit("").alias("before"), F.array().cast(piece).alias("out"))
    end = lambda acc: F.concat(acc["out"], F.array(F.struct(F.concat(acc["before"], acc["rest"]).alias("before"), F.lit("").alias("raw"))))
    cut = F.aggregate(F.split(run, "[ -]"), start, step, end)
    return F.when(is_card(run), F.array(F.struct(F.lit("").alias("before"), run.alias("raw")))).otherwise(cut)


def cut_text(text: Column) -> Column:
    """A text cut at its matches: what lies before the first, the first, what lies between, and so on."""
    raws, between = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    turns = F.flatten(F.zip_with(between, raws, lambda b, r: F.when(r.isNull(), F.array(b)).otherwise(F.array(b, r))))
    return F.when(text.contains(MARK), turns).otherwise(F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1))


def entities_in(cut: Column) -> Column:
    """The matches of a text that was cut, a run of digits without a kind as its pieces: (before, raw, kind), where
    before is the text since the last one. What follows the last match isn't in it."""
    odd = lambda k: F.filter(cut, lambda _, i: i % 2 == k)
    raws, between = odd(1), odd(0)
    run = f"^(?:{PATTERNS['card']})$"

    def pieces(raw: Column, before: Column) -> Column:
        kind = kind_of(raw)
        # What looks like an account and is none may hold a card behind its first four characters.
        head = F.when(raw.rlike(r"^[A-Z]{2}\d{2}[\d ]+$"), F.regexp_extract(raw, "^.{4} ?", 0)).otherwise("")
        digits = F.substring(raw, F.length(head) + 1, F.length(raw))
        one = F.array(F.struct(before.alias("before"), raw.alias("raw"), kind.alias("kind")))
        many = F.transform(cards_in(digits), lambda p, i: F.struct(F.when(i == 0, F.concat(before, head, p["before"])).otherwise(p["before"]).alias("before"), p["raw"].alias("raw"), F.when(p["raw"] != "", "card").alias("kind")))
        return F.when(kind.isNull() & digits.rlike(run), many).otherwise(one)

    return F.flatten(F.zip_with(raws, F.slice(between, F.lit(1), F.size(raws)), pieces))


def draw(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """128 hexadecimal digits that depend on the key, the entity and the attempt."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt))), 256)
    return F.concat(F.sha2(F.concat(F.lit(key), inner), 256), F.sha2(F.concat(F.lit(key + "+"), inner), 256))


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th number (0 to 255) of a stream, from 1; repeats after 64."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(stream, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def same_shape(s: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit of s replaced by one of its script and case."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return (
            F.when(c.rlike(r"\d"), _letter("0123456789", n))
            .when(hexadecimal & c.rlike("[a-f]"), _letter("abcdef", n))
            .when(hexadecimal & c.rlike("[A-F]"), _letter("ABCDEF", n))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), _letter("абвгдежзиклмнопрстуфхцчшэюя", n))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _letter("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", n))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _letter("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _letter("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", n))
            .when(c.rlike(r"\p{Lu}"), _letter(letters.upper(), n))
            .when(c.rlike(r"\p{L}"), _letter(letters, n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _name(stream: Column, canon: Column, ending: str, attempt: int) -> Column:
    def built(syllables: tuple[str, ...], last: str) -> Column:
        table = F.array(*map(F.lit, syllables))
        return F.concat(*[F.element_at(table, _number(stream, i) % len(syllables) + 1) for i in range(3 + attempt)], F.lit(last))

    cyrillic, greek = {"n": "н", "na": "на", "s": "с"}, {"n": "ν", "na": "να", "s": "ς"}
    return F.when(canon.rlike(r"\p{IsCyrillic}"), built(CYRILLIC, cyrillic[ending])).when(canon.rlike(r"\p{IsGreek}"), built(GREEK, greek[ending])).otherwise(built(LATIN, ending))


def candidate(key: str, attempt: int) -> Column:
    """The attempt's surrogate for (kind, canon), as a canonical value."""
    kind, canon = F.col("kind"), F.col("canon")
    s = draw(key, kind, canon, attempt)
    octet = lambda i: (_number(s, i) % 254 + 1).cast("string")
    n = F.length(canon)
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: _letter("0123456789", _number(s, i))), ""))
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    account = same_shape(F.substring(canon, F.lit(5), n), s, F.lit(False))
    state = F.substring(canon, 1, 2)
    iban = F.concat(state, F.lpad((98 - mod_97(F.concat(account, state, F.lit("00")))).cast("string"), 2, "0"), account)
    country = F.regexp_extract(canon, r"^(\+1|\+7|\+\d\d|)", 1)
    phone = F.concat(country, same_shape(F.substring(canon, F.length(country) + 1, n), s, F.lit(False)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    # The domain's own draw: addresses of one domain stay together.
    mail = F.concat(same_shape(local, s, F.lit(False)), F.lit("@"), same_shape(host, draw(key, F.lit("domain"), domain, attempt // 8), F.lit(False)), top)
    return (
        F.when(kind == "ip", F.concat_ws(".", *map(octet, range(4))))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ipv6", same_shape(canon, s, F.lit(True)))
        .when(kind == "iban", iban)
        .when(kind == "phone", phone)
        .when(kind == "email", mail)
        .when(kind == "secret", same_shape(canon, s, canon.rlike("^[0-9a-fA-F]+$")))
        .when(kind == "family", _name(s, canon, "s", attempt))
        .when(kind == "female", _name(s, canon, "na", attempt))
        .when(kind == "male", _name(s, canon, "n", attempt))
    )


def entity_map(entities: DataFrame, folder: str, key: str) -> DataFrame:
    """kind, canon, surrogate: one row for each distinct (kind, canon), injective in each kind."""
    # Drawing is dear for the few bytes a row has: the partitions are fixed, not merged by size.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending = materialize(entities.select("kind", "canon").distinct(), folder, "entities")
    real, given = pending, None
    for attempt in range(MAX_ATTEMPTS):
        drawn = pending.repartition(parts, "kind", "canon").select("kind", "canon", candidate(key, attempt).alias("surrogate"))
        won = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(real.toDF("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        if given is not None:
            won = won.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(won.select("kind", "canon", "surrogate"), folder, f"won-{attempt}")
        given = won if given is None else given.union(won)
        pending = materialize(pending.join(won, ["kind", "canon"], "left_anti"), folder, f"pending-{attempt}")
        if pending.isEmpty():
            return given
    raise RuntimeError(f"{MAX_ATTEMPTS} attempts found no free surrogate")


def parts_of(raw: Column, kind: Column) -> Column:
    """The values of an entity that have surrogates: struct(kind, canon, before, shown)."""
    part = lambda k, canon, before, shown: F.struct(k.alias("kind"), canon.alias("canon"), before.alias("before"), shown.alias("shown"))
    none = F.lit("")
    lead = F.regexp_extract(raw, r"(?is)^(.*?[:=]\s*[\"']?)[a-z0-9+/_=-]{16,}$", 1)
    value = F.substring(raw, F.length(lead) + 1, F.length(raw))
    title = F.regexp_extract(raw, f"^({TITLE} )", 1)
    names = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
    gender = F.when(F.regexp_replace(title, r"\.? $", "").isin(*MALE), "male").otherwise("female")
    only = part(F.lit("family"), F.lower(F.element_at(names, -1)), title, F.element_at(names, -1))
    two = F.array(part(gender, F.lower(names[0]), title, names[0]), part(F.lit("family"), F.lower(F.element_at(names, -1)), F.lit(" "), F.element_at(names, -1)))
    phone = F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits_of(raw))
    return (
        F.when(kind == "person", F.when(F.size(names) > 1, two).otherwise(F.array(only)))
        .when(kind == "secret", F.array(part(kind, value, lead, value)))
        .when(kind == "email", F.array(part(kind, F.lower(raw), none, raw)))
        .when(kind == "card", F.array(part(kind, digits_of(raw), none, raw)))
        .when(kind == "phone", F.array(part(kind, phone, none, raw)))
        .when(kind == "ip", F.array(part(kind, raw, none, raw)))
        .when(kind == "ipv6", F.array(part(kind, F.lower(raw), none, raw)))
        .when(kind == "iban", F.array(part(kind, F.replace(raw, F.lit(" "), F.lit("")), none, raw)))
    )


def laid_out(surrogate: Column, shown: Column, kind: Column) -> Column:
    """A surrogate in the layout of what it stands for."""
    digits = digits_of(surrogate)
    nth = lambda i: F.length(digits_of(F.substring(shown, F.lit(1), i)))
    numbers = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, nth(i + 1), F.lit(1))).otherwise(c)), "")
    cased = F.when((shown == F.upper(shown)) & (shown != F.lower(shown)), F.upper(surrogate)).when(kind.isin("male", "female", "family"), F.initcap(surrogate)).otherwise(surrogate)
    count = lambda i: F.length(F.replace(F.substring(shown, F.lit(1), i), F.lit(" "), F.lit("")))
    grouped = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, count(i + 1), F.lit(1)))), "")
    return F.when(kind.isin("card", "phone"), numbers).when(kind == "iban", grouped).when(kind == "secret", surrogate).otherwise(cased)


def renamed(pieces: Column, last: Column, names: Column) -> Column:
    """What lies before each piece, and the last of a text, with names (shown, value) replaced that stand there as words."""
    between = F.concat(F.transform(pieces, lambda e: e["before"]), F.array(last))
    one = lambda text: F.aggregate(names, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}])\Q"), n["shown"], F.lit(r"\E(?![\p{L}])")), n["value"]))
    apart = F.array_join(between, "").contains(MARK)
    every = F.when(apart, F.transform(between, one)).otherwise(F.split(one(F.array_join(between, MARK)), MARK, -1))
    return F.when(F.size(names) > 0, every).otherwise(between)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, and the number of entities of each kind, for each row. Whoever has
    ``key`` can tell which surrogates belong together in other runs with it."""
    own = plain_columns(docs, doc_id=id_col, text=text_col)
    folder = shared_dir(docs.sparkSession)
    cut = own.select("doc_id", "text", F.when(F.col("text").rlike(HINT), cut_text(F.col("text"))).alias("cut"))
    found = cut.select("doc_id", "text", F.when(F.size("cut") > 1, entities_in(F.col("cut"))).alias("all"), F.element_at("cut", -1).alias("last"))
    is_hit = F.exists("all", lambda e: e["kind"].isNotNull())
    scanned = found.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"), F.when(is_hit, F.col("all")).alias("all"), F.when(is_hit, F.col("last")).alias("last"))
    scanned = materialize(scanned, folder, "scanned")
    hit = scanned.where("all is not null").select("doc_id", "text_hash", "all", "last")
    each = hit.select("doc_id", "text_hash", F.posexplode("all").alias("at", "e")).where("e.kind is not null")
    parts = each.select("doc_id", "text_hash", "at", F.posexplode(parts_of(F.col("e.raw"), F.col("e.kind"))).alias("nth", "p")).select("doc_id", "text_hash", "at", "nth", "p.*").distinct()
    given = entity_map(parts, folder, key)
    value = laid_out(F.col("surrogate"), F.col("shown"), F.col("kind")).alias("value")
    drawn = parts.join(given, ["kind", "canon"]).select("doc_id", "text_hash", "at", "nth", "before", "shown", value, F.col("kind").isin("male", "female", "family").alias("name"))
    new = drawn.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "nth", F.concat("before", "value").alias("out"), "name", "shown", "value"))).alias("new"))
    both = hit.alias("h").join(new.alias("n"), F.expr("h.doc_id <=> n.doc_id and h.text_hash = n.text_hash")).select("h.*", "n.new")
    names = F.array_distinct(F.transform(F.filter("new", lambda x: x["name"]), lambda x: F.struct(x["shown"].alias("shown"), x["value"].alias("value"))))
    both = both.withColumn("between", renamed(F.col("all"), F.col("last"), names))
    replaced = F.transform("all", lambda e, i: F.when(e["kind"].isNull(), e["raw"]).otherwise(F.array_join(F.transform(F.filter("new", lambda x: x["at"] == i), lambda x: x["out"]), "")))
    joined = F.array_join(F.zip_with("between", replaced, lambda b, e: F.concat(b, F.coalesce(e, F.lit("")))), "")
    count = lambda k: F.size(F.filter("all", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    done = both.select("doc_id", joined.alias("text"), *map(count, KINDS))
    rest = scanned.where("all is null")
    return done.unionByName(rest.select("doc_id", "text", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS]))
