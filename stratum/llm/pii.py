"""Operator 2: format-preserving Feistel pseudonyms (DataFrame functions only).

Personal values are found by one pattern, validated, and replaced by another value of the
same format: card numbers that again pass the Luhn test, dotted addresses with octets up to
255, dates that exist, phone numbers and mail names with letters and digits in the same
places. The replacement is a keyed permutation of the format's values, so equal values get
equal pseudonyms in all documents and different values different ones. Nothing is shared
between rows; the corpus needs no shuffle and no table of seen values.

The permutation is a balanced Feistel network over a list of digits with a base each. A
round adds to the digits of one half a keyed SHA-512 stream of the other half, each digit
modulo its base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, text_of

#: The key of the registered query; a production run passes its own.
KEY = "stratum pseudonym key"
ROUNDS = 8
#: Dates from 1900-01-01 on, 200 years of 365 days, are permuted among themselves.
FIRST_DAY, YEARS, DAYS = "1900-01-01", 200, 365

#: A host name has 63 characters in a label and 127 labels at most; the bounds keep Java's matcher, which recurses
#: once for each label, from running out of stack.
HOST = r"(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,}"
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+@{HOST}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
US_PHONE = r"(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"
#: What begins a value of its own after a blank or hyphen; no number runs into it.
OWN = (r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|\d{4}-\d{2}-\d{2}(?![\d-])|\d{13,19}(?!\d)"
       rf"|[A-Za-z0-9._%+-]{{1,64}}+@{HOST}")
NANP_PHONE = r"(?<!\d)\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
#: At most 15 digits; a longer run is cut where a group ends.
PHONE = (rf"(?<!\d)\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?![ -](?:{OWN}))[ .-]?\d{{2,4}}){{1,4}}(?!\d)"
         + r"(?<!\+\d" + r"[ .()-]{0,3}\d" * 15 + r"[\d .()-]{0,32})")
#: A run of digits, in which ``cut_run`` looks for card numbers.
RUN = rf"(?<![\d+])\d(?:(?![ -](?:{OWN}|(?:\(\d{{3}}\) ?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}}(?!\d)))[ -]?\d){{12,63}}(?!\d)"
#: Card numbers at the beginning of a text, in order of preference.
CARDS = (r"^\d{13,19}(?!\d)", r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)", r"^\d{4}([ -])\d{6}\1\d{5}(?!\d)",
         *(rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)" for n in range(19, 12, -1)))
#: Alternatives in order of preference at one place.
ANY = "|".join((EMAIL, IPV4, DATE, NANP_PHONE, PHONE, US_PHONE, RUN))
KINDS = ("email", "ip", "date", "phone", "card")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit counted once."""
    n = F.length(number)
    value = F.transform(_chars(number), lambda c, i: F.when(
        (n - i) % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x)


def kind_of(hit: Column) -> Column:
    """The kind of a valid hit, null for one that fails its check."""
    octets = F.split(hit, r"\.")
    return (F.when(F.contains(hit, F.lit("@")), "email")
            .when(hit.rlike(f"^(?:{IPV4})$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
            .when(hit.rlike(f"^(?:{DATE})$"), F.when(
                F.datediff(F.try_to_date(hit, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).between(0, YEARS * DAYS - 1), "date"))
            .when(hit.startswith("+") | hit.rlike(f"^(?:{US_PHONE})$"),
                  F.when(F.length(_digits(hit)).between(7, 15), "phone")))


def cut_run(run: Column) -> Column:
    """The pieces (hit, kind) of a run of digits: card numbers that begin and end with its groups, and the rest.

    From left to right, at each group the first of ``CARDS`` that passes the Luhn test; groups
    of one digit are no card's unless the whole run is one.
    """
    piece = lambda hit, kind: F.struct(hit.alias("hit"), F.lit(kind).cast("string").alias("kind"))
    passes = lambda c: (c != "") & (luhn_sum(_digits(c)) % 10 == 0)
    starts = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: F.substr(run, F.greatest(i - 1, F.lit(1)), F.when(
        i > 1, 2).otherwise(1)).rlike(r"^[ -]?\d$"))
    found = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), F.get(F.filter(
        F.array(*[F.regexp_extract(F.substr(run, i, F.lit(40)), c, 0) for c in CARDS]),
        lambda c: ~c.rlike(r"(?:^|[ -])\d(?:[ -]|$)") & passes(c)), F.lit(0)).alias("card"))), lambda x: x["card"].isNotNull())
    none = F.array().cast("array<struct<hit:string,kind:string>>")
    cut = F.aggregate(
        found, F.struct(F.lit(1).alias("free"), none.alias("pieces")),
        lambda a, x: F.when(x["at"] < a["free"], a).otherwise(F.struct(
            (x["at"] + F.length(x["card"])).alias("free"),
            F.concat(a["pieces"], F.array(piece(F.substr(run, a["free"], x["at"] - a["free"]), None),
                                          piece(x["card"], "card"))).alias("pieces"))),
        lambda a: F.concat(a["pieces"], F.array(piece(F.substr(run, a["free"]), None))))
    whole = (F.size(cut) == 1) & F.length(_digits(run)).between(13, 19) & passes(run)
    return F.when(whole, F.array(piece(run, "card"))).otherwise(cut)


def permuted(values: Column, bases: Column, key: Column) -> Column:
    """A keyed permutation of the digit lists with these bases (``bases[i]`` values each)."""
    half = F.floor(F.size(values) / 2).cast("int")
    left = lambda a: F.slice(a, 1, half)
    right = lambda a: F.slice(a, half + 1, F.size(a))
    start = F.struct(left(values).alias("a"), right(values).alias("b"), left(bases).alias("p"), right(bases).alias("q"))

    def one_round(s: Column, i: Column) -> Column:
        # 32 digits take one block of the stream; a mail name has at most 64 characters
        seed = F.concat_ws(":", key, i.cast("string"), F.array_join(s["b"].cast("array<string>"), ","))
        stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit(":2")), 512))
        added = F.transform(F.arrays_zip(s["a"].alias("x"), s["p"].alias("m")), lambda z, j: F.pmod(
            z["x"] + F.conv(F.substr(stream, j * 4 + 1, F.lit(4)), 16, 10).cast("int"), z["m"]))
        return F.struct(s["b"].alias("a"), added.alias("b"), s["q"].alias("p"), s["p"].alias("q"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, lambda s: F.concat(s["a"], s["b"]))


def _permute_text(text: Column, key: Column) -> Column:
    """Letters and digits permuted within their case and place; all else stays."""
    chars = _chars(text)
    code = lambda c: F.ascii(c)
    low = lambda c: (F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[a-z]$"), 97))
    base = F.transform(chars, lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1))
    value = F.transform(chars, lambda c: F.when(low(c).isNull(), 0).otherwise(code(c) - low(c)))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    new = permuted(value, base, F.concat_ws("|", key, form))
    return F.array_join(F.zip_with(chars, new, lambda c, v: F.when(low(c).isNull(), c).otherwise(F.chr(low(c) + v))), "")


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid hit, of the same kind and format."""
    tag = lambda k: F.lit(f"{key}|{k}")
    at = F.instr(hit, "@")
    email = F.concat(_permute_text(F.substr(hit, F.lit(1), at - 1), tag("email")), F.substr(hit, at))
    octets = F.transform(F.split(hit, r"\."), lambda o: o.cast("int"))
    ip = F.array_join(permuted(octets, F.array_repeat(F.lit(256), 4), tag("ip")).cast("array<string>"), ".")
    day = F.datediff(F.try_to_date(hit, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    moved = permuted(F.array(F.floor(day / DAYS).cast("int"), (day % DAYS).cast("int")),
                     F.array(F.lit(YEARS), F.lit(DAYS)), tag("date"))
    date = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved[0] * DAYS + moved[1]), "yyyy-MM-dd")
    code = F.regexp_extract(hit, r"^(\+\d{1,3}(?=[^\d]))", 1)  # the country stays
    phone = F.concat(code, _permute_text(F.substr(hit, F.length(code) + 1), tag("phone")))
    body = F.substr(hit, F.lit(1), F.length(hit) - 1)
    shown = _permute_text(body, tag("card"))
    check = (10 - luhn_sum(F.concat(_digits(shown), F.lit("0"))) % 10) % 10
    card = F.concat(shown, check.cast("string"))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date)
            .when(kind == "phone", phone).when(kind == "card", card).otherwise(hit))


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Per document: ``doc_id``, the new ``text``, ``n_email, n_ip, n_date, n_phone, n_card`` and ``n_pii``.

    Values that fail their check (Luhn, octets, calendar, length) stay as they are; a number
    beside a value does not hide it.

    Defined cases: null and empty texts give an empty text; a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; further columns are
    ignored whatever their names.
    """
    df = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    none = F.array().cast("array<string>")
    may = F.col("text").rlike("[0-9@]")  # most texts hold neither and are passed through
    df = df.select("*", F.inline(F.array(F.struct(
        F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none).alias("hits"),
        F.when(may, F.split("text", ANY, -1)).otherwise(F.array("text")).alias("rest")))))
    df = df.select("doc_id", "rest", F.inline(F.array(F.struct(F.transform("hits", lambda h: F.when(
        h.rlike(r"^\d(?:[ -]?\d){12,}$"), cut_run(h)).otherwise(F.array(F.struct(
            h.alias("hit"), kind_of(h).alias("kind"))))).alias("hits")))))
    new = F.transform("hits", lambda h: F.array_join(F.transform(h, lambda p: pseudonym(p["hit"], p["kind"], key)), ""))
    text = F.when(F.size("hits") == 0, F.get("rest", F.lit(0))).otherwise(F.array_join(F.zip_with(
        "rest", new, lambda r, h: F.concat(r, F.coalesce(h, F.lit("")))), ""))
    count = lambda k: F.size(F.filter(F.flatten("hits"), lambda h: h["kind"] == k)).cast("long")
    return df.select("doc_id", text.alias("text"), *[count(k).alias(f"n_{k}") for k in KINDS],
                     F.size(F.filter(F.flatten("hits"), lambda h: h["kind"].isNotNull())).cast("long").alias("n_pii"))


def op2_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"))
