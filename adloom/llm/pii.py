"""Personal data in texts: detected entities get keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.texts import map_rows, text_struct
from adloom.operators import membership
from adloom.session import materialize

# Forms of address that tell a name, and the gender they tell.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Signor Don Господин Κύριος Κύριε".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Señorita Signora Doña Госпожа Κυρία".split(),
}
_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}

# Syllables from which names are made for each script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha jo ka ke ko la le lo ma me mo na ne no pa ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве го да до за ка ко ла ле ло ма ме мо на не но па ра ре ро са се та то".split(),
    "greek": "βα βε γα γο δα δε θα κα κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε τα το".split(),
}
ENDINGS = {
    "latin": {"m": ["rt", "n", "s"], "f": ["na", "lia", "ra"], "": ["rd", "nn", "lt"]},
    "cyrillic": {"m": ["р", "н", "м"], "f": ["на", "ра", "ля"], "": ["нов", "ров", "лин"]},
    "greek": {"m": ["ς", "νος", "ρος"], "f": ["να", "ρα", "λη"], "": ["δης", "κος", "λος"]},
}

_NAME = r"[^\W\d_a-zа-яёα-ωά-ώ][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_ADDRESSED = "|".join(sorted(_GENDER, key=len, reverse=True))

#: Kinds in the order in which they are tried at a place. Numbers are of ASCII digits; others are no entities.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "phone": (
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)"
        r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"
    ),
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "name": rf"(?<!\w)(?:{_ADDRESSED})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS.items()))
_OTHERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS.items() if kind != "card"))

#: What a text with personal data certainly holds, for a first look without Python; there, digits are those of ASCII.
HINT = rf"@|\+[0-9]|\d[\d .()-]{{5,}}\d|[A-Z]{{2}}\d{{2}}|(?:{_ADDRESSED})"


def luhn(digits: str) -> int:
    """The sum of the card checksum; right ones give a multiple of ten."""
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled)


def script_of(word: str) -> str:
    """The script of a word by its first letter; Latin if it is none of the others."""
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def card_in(said: str, seen: int = 0) -> tuple[int, int] | None:
    """Where the longest card of some successive groups of digits lies, the first of equally long ones.

    Groups that end at `seen` or before are known to be none.
    """
    groups = [g.span() for g in re.finditer(r"[0-9]+", said)]
    best, most = None, 12
    for k, (start, _) in enumerate(groups):
        digits = ""
        for low, high in groups[k:]:
            digits += said[low:high]
            if high > seen and most < len(digits) <= 19 and not luhn(digits) % 10:
                best, most = (start, high), len(digits)
    return best


def _places(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of what the patterns find, cards with a right checksum only.

    Where a run of digits is no card as a whole, another kind at its start goes first, then a card of some of its groups;
    without either the search goes on at the next character.
    """
    at = seen = 0
    while m := _ANY.search(text, at):
        start, at = m.span()
        card = card_in(m[0], seen - start) if m.lastgroup == "card" else None
        if m.lastgroup != "card" or card == (0, len(m[0])):
            yield m.lastgroup, start, at
        elif other := _OTHERS.match(text, start):
            yield other.lastgroup, start, (at := other.end())
        elif card:
            yield from ((o.lastgroup, *o.span()) for o in _OTHERS.finditer(text, start, start + card[0]))
            at = start + card[1]
            yield "card", start + card[0], at
        else:
            seen, at = at, start + 1


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of each entity; a value is the same however it is written.

    Numbers are cards only with a right checksum, also some groups of a longer number. A name has an entity for each of its words, so that `Mr John Smith` and
    `Mrs Smith` share one: the last word is a family name, the others are given names of the gender of the title. Where the
    same word, in the same letters, stands alone elsewhere in the text, it is that entity again.
    """
    found = []
    names_said: dict[str, tuple[str, str]] = {}
    for kind, start, end in _places(text or ""):
        said = text[start:end]
        if kind == "name":
            title, *names = re.finditer(r"\S+", said)
            gender = _GENDER[title[0].rstrip(".")]
            for k, name in enumerate(names):
                role = f"given_{gender}" if k < len(names) - 1 else "family"
                found.append((start + name.start(), start + name.end(), role, name[0].lower()))
                names_said.setdefault(name[0], (role, name[0].lower()))
            continue
        value = said.lower() if kind in ("email", "ip") else re.sub(r"[^A-Za-z0-9]", "", said)
        found.append((start, end, kind, value))
    return found + _again(text or "", names_said, found) if names_said else found


def _again(
    text: str, names: dict[str, tuple[str, str]], found: list[tuple[int, int, str, str]]
) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names of a text, outside of what was found."""
    taken, out, k = [(a, b) for a, b, _, _ in found], [], 0
    for m in re.finditer(r"[^\W\d_]+(?:[-'’][^\W\d_]+)?", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if m[0] in names and (k == len(taken) or m.end() <= taken[k][0]):
            out.append((*m.span(), *names[m[0]]))
    return out


#: Attempts in a row that keep the format; then there is more room, as all values of a format may be taken.
NARROW = 8


class _Stream:
    """Numbers that depend on a key and a label alone."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.block, self.bytes = key, label, 0, b""

    def below(self, n: int) -> int:
        while len(self.bytes) < 4:
            self.bytes += hmac.digest(self.key, f"{self.label}\0{self.block}".encode(), "sha256")
            self.block += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return x * n >> 32

    def like(self, text: str) -> str:
        """Digits for digits and letters for letters; a leading digit stays other than zero, or zero."""
        out = []
        for k, c in enumerate(text):
            if c.isdigit():
                out.append(str(1 + self.below(9)) if k == 0 and c != "0" else c if k == 0 else str(self.below(10)))
            elif c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """A value of the same kind and format for a value; another one for each attempt.

    Mail addresses keep their last domain label, and equal domains stay equal. Cards keep their first digit, length and
    checksum, IBANs country and checksum, phone numbers their first digit, IPs the length of each part. Names keep
    script and gender. Every `NARROW` attempts there is more room: IPs have parts of any length, social security numbers
    any first digit, mail addresses and phone numbers one more character; names have one more syllable every four.
    """
    s = _Stream(key, f"{kind}\0{value}\0{attempt}")
    wide = attempt // NARROW
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, last = domain.rpartition(".")
        return f"{s.like(local + 'a' * wide)}@{_Stream(key, f'domain\0{domain}').like(host)}.{last}"
    if kind == "ip":
        spans = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        bounds = [(1, 255) if wide else spans[len(part)] for part in value.split(".")]
        return ".".join(str(low + s.below(high - low + 1)) for low, high in bounds)
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[2:])
        return body + str(-luhn(body + "0") % 10)
    if kind == "iban":
        body = s.like(value[4:])
        number = "".join(str(int(c, 36)) for c in body + value[:2] + "00")
        return f"{value[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "phone":
        return value[0] + s.like("1" + value[1:] + "0" * wide)[1:]
    if kind == "ssn":
        return (str(s.below(10)) if wide else value[0]) + s.like("1" + value[1:])[1:]
    script, gender = script_of(value), kind[6:]
    size = max(1, min(4, (len(value) - 2) // 2)) + attempt // 4
    parts = [SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(size)]
    return "".join(parts) + ENDINGS[script][gender][s.below(3)]


def written_like(made: str, said: str) -> str:
    """A surrogate in the capitals and separators of the mention it stands for."""
    if made.isalpha() and said[:1].isalpha():
        return made.upper() if said.isupper() and len(said) > 1 else made.capitalize()
    if "@" in said or "." in made:
        return made.upper() if said.isupper() else made
    rest = iter(made)
    return "".join([*(next(rest, "") if c.isalnum() else c for c in said), *rest])


def replaced(text: str | None, known: dict[tuple[str, str], str]) -> str | None:
    """The text with the surrogates of its entities."""
    if not text or not known:
        return text
    out, at = [], 0
    for start, end, kind, value in sorted(entities(text)):
        out += [text[at:start], written_like(known[kind, value], text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def _likely(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(HINT)), F.lit(False))


MENTIONS = "doc_id long, print long, kind string, value string"


def mentions(docs: DataFrame) -> DataFrame:
    """The entities of documents: doc_id, print (a hash of the text), kind, value."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            out: dict[str, list] = {"doc_id": [], "print": [], "kind": [], "value": []}
            for doc, made, text in zip(part["doc_id"], part["print"], part["text"], strict=True):
                for kind, value in dict.fromkeys((kind, value) for _, _, kind, value in entities(text)):
                    for name, v in zip(out, (doc, made, kind, value), strict=True):
                        out[name].append(v)
            yield out

    likely = docs.filter(_likely(F.col("text"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text"
    )
    return map_rows(likely, MENTIONS, rows)


def surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """One surrogate for each distinct kind and value: kind, value, surrogate, all different within a kind.

    Each round offers a surrogate to all values without one. An offer that is a value of the data itself or taken
    already is refused; of several values with one offer the smallest gets it. The rest goes on to the next round, and
    later rounds have more room, so that it ends however many values of one format there are.
    """

    def offers(attempt: int):
        def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            for part in slices:
                both = list(zip(part["kind"], part["value"], strict=True))
                yield part | {"surrogate": [surrogate(kind, value, attempt, key) for kind, value in both]}

        return rows

    schema = "kind string, value string, surrogate string"
    every = materialize(values.select("kind", "value").distinct(), "values")
    taken = every.select("kind", F.col("value").alias("surrogate"))
    rounds, left, attempt = [], every, 0
    while True:
        free = map_rows(left, schema, offers(attempt)).join(taken, ["kind", "surrogate"], "left_anti")
        won = materialize(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")), "surrogates")
        rounds.append(won.select("kind", "value", "surrogate"))
        left = materialize(left.join(won, ["kind", "value"], "left_anti"), "left")
        if left.isEmpty():
            return reduce(DataFrame.union, rounds)
        taken = taken.union(won.select("kind", "surrogate"))
        attempt += 1


KEY = b"adloom"


def pseudonymised(docs: DataFrame, key: bytes = KEY, text: str = "text", counts: str = "pii") -> DataFrame:
    """Replace personal data in `text`, and add the map `counts` of how many different values of each kind there were.

    The same value gets the same surrogate in every document, different ones get different ones, none is a value of
    the data. Null and empty texts stay, repeated rows get the same text, no rows give none, other columns stay, save one
    called `counts`, which is replaced. Rows need a doc_id column, which may be null.

    Texts are looked at once, for their mentions. A filter of bounded size over the texts that have some tells which
    are dealt out to meet their surrogates; all others pass by.
    """
    own = [c for c in docs.columns if c != counts]
    docs = docs.select(*own)
    said = materialize(mentions(docs.select("doc_id", F.col(text).alias("text"))), "mentions")
    named = said.join(surrogates(said, key), ["kind", "value"])
    entry = F.struct("kind", "value", "surrogate")
    known = named.groupBy("doc_id", "print").agg(F.collect_set(entry).alias("_known"))
    known = known.select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), "_known")
    prints = said.select("print").distinct()
    shape = membership.sized(prints.count())
    own_print = docs.withColumn("_own", F.xxhash64(text))
    told = membership.flagged(own_print, "_own", membership.key_filter(prints, "print", shape), shape, "_likely")
    here = told.filter("_likely").join(
        known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_print")), "left"
    )

    def fields(row: dict) -> tuple:
        found = {(x["kind"], x["value"]): x["surrogate"] for x in row["known"] or ()}
        kinds = [kind for kind, _ in found]
        return replaced(row["text"], found), [(kind, kinds.count(kind)) for kind in sorted(set(kinds))]

    made = text_struct(F.struct(F.col(text).alias("text"), F.col("_known").alias("known")), "text string, n map<string,long>", fields)
    here = here.withColumn("_made", made)
    out = [F.col("_made.text").alias(text) if c == text else F.col(c) for c in own]
    here = here.select(*out, F.col("_made.n").alias(counts))
    rest = told.filter(~F.col("_likely")).select(*own, F.expr("cast(map() as map<string,bigint>)").alias(counts))
    return here.unionByName(rest)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and the number of different values by kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.coalesce(F.try_element_at("pii", F.lit(kind)), F.lit(0))
    kinds = ["email", "phone", "ip", "card", "iban", "ssn"]
    names = count("given_m") + count("given_f") + count("family")
    out = pseudonymised(docs).select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in kinds], names.alias("n_name"))
    return out


QUERIES = {"op3_surrogate_pii": pii_query}
ORACLE: dict[str, str] = {}
