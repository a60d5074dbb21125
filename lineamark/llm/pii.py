"""Surrogates for personal data: keyed, type-consistent, distinct, and the same for every mention.

Detected entities are replaced by others of their type and format: letters stay letters of their script and case,
vowels stay vowels in names, digits digits, separators stand; check digits (card numbers, IBAN) are made anew; listed
given names are replaced by names of the same gender and script, others get an ending of the title's gender. Names are
found by their title; their words are then replaced wherever the text has them, capitalised or in capitals (a
word in small letters isn't taken for a name, nor is one of COMMON). A surrogate is the image of the entity under a keyed
permutation of all strings of its format, made without a fixed point: an encryption E, a step on, and back. Where
formats could meet, the permutation is walked until it is back in its own: phone numbers with a 555 exchange and
others, reserved mail domains and others, listed names and others. So distinct entities keep distinct surrogates, an
entity gets one surrogate wherever and however it is written, none is left as it was, and no table of entities is
needed. In each document surrogates are checked against the entities too; should two entities ever meet, the later
one takes the next of its surrogates, under further keys, that is free.

A name's words begin with a capital, or are in a script without case. A listed name follows its list, whatever the
title. All searches take time in proportion to the text, runs of one kind of character included.

A null text stays null, an empty one empty. Repeated rows get the same result. Entities may not overlap: the one
that begins first, then the longer one, counts. A part with nothing to permute stands as it is. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineamark.llm.shared import free_name, small_batches
from lineamark.llm.spans import lean, pieces

KEY = "a key for tests; give your own"

# Titles that precede names, with gender; given names by script and gender; letters by script.
TITLES = {
    "Mr": "m",
    "Mr.": "m",
    "Mister": "m",
    "Herr": "m",
    "Herrn": "m",
    "Monsieur": "m",
    "M.": "m",
    "Señor": "m",
    "Sr.": "m",
    "Don": "m",
    "Mrs": "f",
    "Mrs.": "f",
    "Ms": "f",
    "Ms.": "f",
    "Miss": "f",
    "Frau": "f",
    "Madame": "f",
    "Mme": "f",
    "Mme.": "f",
    "Mlle": "f",
    "Señora": "f",
    "Señorita": "f",
    "Sra.": "f",
    "Srta.": "f",
    "Doña": "f",
    "господин": "m",
    "госпожа": "f",
    "κύριος": "m",
    "κυρία": "f",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Paul Mark George Peter Hans Karl Stefan Jürgen Klaus Pierre Jean Michel Louis Carlos José Juan Miguel Pedro".split(),
    ("latin", "f"): "Mary Anna Linda Susan Karen Nancy Lisa Helen Sandra Laura Emma Julia Petra Sabine Monika Ursula Marie Claire Sophie Camille Carmen María Lucía Isabel Elena Rosa".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Ειρήνη".split(),
}
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñß"),
    "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"),
}
LISTED = {n.lower(): (group, k) for group, names in GIVEN.items() for k, n in enumerate(names)}
#: What ends an unlisted given name's surrogate, by script and gender.
ENDINGS = {"latin": {"m": "o", "f": "a"}, "cyrillic": {"m": "н", "f": "а"}, "greek": {"m": "ς", "f": "α"}}
#: Words that may follow a name with a capital and are none.
COMMON = set("""the a an and or but in on at of to for from by with as is was were are has had he she it they we you his her this that
if when then der die das und oder er sie es wir ihr in im am an auf aus bei mit von zu ist war le la les un une et ou il elle nous vous
de du des en est el los las y o ella es de del al и в на но он она они это ο η το οι και στο στη από με""".split())
ALPHABETS = [a for script in LETTERS.values() for a in script]
DIGITS, HEX, CODE, LATIN = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"

USER = re.compile(r"[\w.%+\-]")
HOST = re.compile(r"[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")
RESERVED = re.compile(r"(?i)(?:^|\.)(?:example\.(?:com|net|org)|example|test|invalid)$")
OURS = ".x.example"
SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|ghs)_[0-9A-Za-z]{30,}|\bsk-[0-9A-Za-z_\-]{20,}")
NAMED_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\b[\"']?\s*[:=]\s*[\"']?([^\s\"'<>|]{8,})")
NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<card>(?<![\d.])(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?!\d))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,5}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-]))"
)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
NAME = re.compile(
    r"(?<!\w)(" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r") ((?:[^\W\d_a-z][^\W\d_]+)(?:[ \-][^\W\d_a-z][^\W\d_]+){0,2})"
)
WORD = re.compile(r"\w+")
HAS_DIGIT = re.compile(r"\d")
SECRET_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-")


class Permutation:
    """A keyed permutation of the numbers below n, and from it one without fixed points."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        return int.from_bytes(
            hashlib.blake2b(tweak + bytes([k]) + half.to_bytes(size + 1, "big"), key=self.key, digest_size=min(64, max(8, size + 1))).digest(),
            "big",
        ) & ((1 << bits) - 1)

    def cipher(self, tweak: bytes, x: int, n: int, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:  # walk until the number is below n again: at most four steps on average
            a, b = x >> bits, x & mask
            for k in reversed(range(8)) if back else range(8):
                if back:
                    a, b = b ^ self.round(tweak, k, a, bits), a
                else:
                    a, b = b, a ^ self.round(tweak, k, b, bits)
            x = (a << bits) | b
            if x < n:
                return x

    def moved(self, tweak: bytes, x: int, n: int) -> int:
        """The image of x: never x itself, where n is 2 or more."""
        return x if n < 2 else self.cipher(tweak, (self.cipher(tweak, x, n, False) + 1) % n, n, True)


class Surrogates:
    def __init__(self, key: str) -> None:
        self.key = key
        self.p = Permutation(hashlib.sha256(key.encode()).digest())
        self.of = lru_cache(100_000)(self.of)

    def other(self, number: int) -> Surrogates:
        """Surrogates under a further key."""
        return Surrogates(f"{self.key}#{number}")

    def string(self, kind: str, text: str, alphabets: list[str | None], tweak: str = "") -> str:
        """Permute the characters that have an alphabet, as one number; case stays in its place."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        x, n = 0, 1
        for c, a in zip(low, alphabets, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        form = "".join(a[0] if a else c for c, a in zip(low, alphabets, strict=True))
        y = self.p.moved(f"{kind}|{tweak}|{form}|{len(text)}".encode(), x, n)
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                y, d = divmod(y, len(a))
                c = a[d].upper() if c != c.lower() and len(a[d].upper()) == 1 else a[d]
            out.append(c)
        return "".join(reversed(out))

    def plain(self, kind: str, text: str, radix: str | None = None) -> str:
        return self.string(
            kind,
            text,
            [radix if radix and c.lower() in radix else DIGITS if c in DIGITS else LATIN if c.lower() in LATIN else None for c in text],
        )

    def of(self, kind: str, text: str) -> str:
        return getattr(self, kind)(text)

    def host(self, name: str) -> str:
        """A permutation of names of one format; those that end in the label x stay apart from the others."""
        while True:
            name = self.plain("host", name)
            if not re.search(r"(?i)(?:^|\.)x$", name):
                return name

    def email(self, text: str) -> str:
        """The user's part and the domain are permuted apart. Reserved domains keep their end; others get OURS, and
        what has that end already gets one x more, so that the number of x tells them apart."""
        user, _, domain = text.rpartition("@")
        low, new = domain.lower(), self.plain("email", user) + "@"
        if low.endswith(OURS) or low == OURS[1:]:
            rest, xs = domain[: -len(".example")], 0
            while rest.lower() == "x" or rest.lower().endswith(".x"):
                rest, xs = rest[:-2], xs + 1
            return new + ".".join([self.host(rest)] * bool(rest) + ["x"] * (xs + 1) + ["example"])
        kept = RESERVED.search(domain)
        if not kept:
            return new + self.host(domain) + OURS
        return new + (self.host(domain[: kept.start()]) if kept.start() else "") + domain[kept.start() :]

    def secret(self, text: str) -> str:
        head = next((h for h in SECRET_HEADS if text.startswith(h)), "")
        rest = text[len(head) :]
        upper = rest.upper() == rest
        new = self.plain("secret", rest, HEX if re.fullmatch("[0-9a-f]+|[0-9A-F]+", rest) else CODE if upper or rest.lower() == rest else None)
        return head + (new.upper() if upper else new)

    def digits(self, kind: str, text: str, fixed: set[int]) -> str:
        """Permute the digits of text but those numbered in fixed; the same digits in another format get the same."""
        own = [c for c in text if c in DIGITS]
        new = iter(self.string(kind, "".join(own), [None if k in fixed else DIGITS for k in range(len(own))]))
        return "".join(next(new) if c in DIGITS else c for c in text)

    def phone(self, text: str) -> str:
        """Country code and a 555 exchange stand; the last ten digits decide the surrogate."""
        own = [c for c in text if c in DIGITS]
        extra = max(0, len(own) - 10)
        last = "".join(own[extra:])
        fake = len(last) == 10 and last[3:6] == "555"
        while True:
            last = self.string("phone", last, [None if fake and k in (3, 4, 5) else DIGITS for k in range(len(last))])
            if fake or len(last) < 10 or last[3:6] != "555":
                break
        new = iter([*own[:extra], *last])
        return "".join(next(new) if c in DIGITS else c for c in text)

    def ssn(self, text: str) -> str:
        return self.digits("ssn", text, set())

    def card(self, text: str) -> str:
        """The first digit stands; those between are permuted among numbers of its Luhn sum, which the last keeps as it was, modulo 10."""
        own = [int(c) for c in text if c in DIGITS]

        def luhn(d: list[int]) -> int:
            return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10

        body = self.string("card", "".join(map(str, own[1:-1])), [DIGITS] * (len(own) - 2), f"{own[0]}|{luhn(own)}")
        new = [own[0], *map(int, body), 0]
        new[-1] = (luhn(own) - luhn(new)) % 10
        it = iter(new)
        return "".join(str(next(it)) if c in DIGITS else c for c in text)

    def ip(self, text: str) -> str:
        """Private networks keep their prefix; others stay outside of them."""
        octets = [int(x) for x in text.split(".")]
        keep = 2 if octets[:2] == [192, 168] else 1 if octets[0] in (0, 10, 127) else 0
        n = 256 ** (4 - keep)
        x = int.from_bytes(bytes(octets[keep:]), "big")
        while True:
            x = self.p.moved(f"ip|{octets[:keep]}".encode(), x, n)
            new = [*octets[:keep], *x.to_bytes(4 - keep, "big")]
            if keep or not (new[0] in (0, 10, 127) or new[:2] == [192, 168]):
                return ".".join(map(str, new))

    def iban(self, text: str) -> str:
        own = text.replace(" ", "")
        rest = self.plain("iban", own[4:])
        number = "".join(str(int(c, 36)) for c in rest + own[:2] + "00")
        new = iter(own[:2] + f"{98 - int(number) % 97:02d}" + rest)
        return "".join(c if c == " " else next(new) for c in text)

    def name(self, text: str) -> str:
        """text: a gender for each word that is a given name, and the name after a bar. Listed names move in their list, others by letters."""
        genders, _, name = text.partition("|")
        gender = iter(genders.split(","))
        return "".join(p if p in " -" else self.part(p, next(gender)) for p in re.split(r"([ \-])", name))

    def part(self, word: str, gender: str) -> str:
        group, k = LISTED.get(word.lower(), ((None, None), 0))
        if group[0]:
            names = GIVEN[group]
            new = names[self.p.moved(f"given|{group}".encode(), k, len(names))]
            return new.upper() if word.isupper() and len(word) > 1 else new
        while True:
            word = self.string("name", word, [next((a for a in ALPHABETS if c.lower() in a), None) for c in word])
            if word.lower() not in LISTED or not any(c.lower() in a for c in word for a in ALPHABETS):
                break
        script = next((s for s, alphabets in LETTERS.items() if any(c in a for c in word.lower() for a in alphabets)), None)
        if not gender or not script:
            return word
        end = ENDINGS[script][gender].upper() if word.isupper() else ENDINGS[script][gender]
        # a listed name is no image of the permutation, so the second ending tells it from all others
        return word + end * (2 if (word + end).lower() in LISTED else 1)


def named(gender: str, name: str) -> str:
    """What a titled name's surrogate is made from: the first of more words is a given name of the title's gender."""
    n = len(re.split(r"[ \-]", name))
    return ",".join([gender if " " in name else "", *[""] * (n - 1)]) + "|" + name


def mentions(text: str, sources: list[str], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The places between those taken where the words of names are, alone or in a row, with the words' genders."""
    gender: dict[str, str] = {}
    forms = set()
    for source in sources:
        genders, _, name = source.partition("|")
        for g, w in zip(genders.split(","), re.split(r"[ \-]", name), strict=True):
            if w.lower() not in COMMON:
                gender.setdefault(w.lower(), g)
                forms |= {w, w.upper(), w.capitalize()}
    if not forms:
        return []
    out, ahead = [], iter([*taken, (len(text) + 1, 0, "", "")])
    wall = next(ahead)
    for m in WORD.finditer(text):
        while m.start() >= wall[1] and wall[0] <= len(text):
            wall = next(ahead)
        if m.group() in forms and m.end() <= wall[0]:
            if out and out[-1][1] + 1 == m.start() and text[m.start() - 1] in " -":
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
    return [(a, b, "name", ",".join(gender.get(w.lower(), "") for w in re.split(r"[ \-]", text[a:b])) + "|" + text[a:b]) for a, b in out]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where addresses are: from each @ to both sides, so that no run of characters is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and USER.match(text[begin - 1]):
            begin -= 1
        host = HOST.match(text, at + 1)
        done = host.end() if begin < at and host else at + 1
        if begin < at and host:
            yield begin, done
        at = text.find("@", done)


def titled(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names after a title: up to three words, until one that begins with a small letter."""
    for m in NAME.finditer(text):
        words = re.split(r"([ \-])", m.group(2))
        n = next((k for k in range(0, len(words), 2) if words[k][0].islower()), len(words) + 1)
        if n:
            name = "".join(words[: n - 1])
            yield m.start(2), m.start(2) + len(name), "name", named(TITLES[m.group(1)], name)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """begin, end, kind, and what the surrogate is made from, in order and without overlap."""
    found = []
    if "@" in text:
        found += [(a, b, "email", text[a:b]) for a, b in emails(text)]
    if HAS_DIGIT.search(text):
        found += [(m.start(), m.end(), m.lastgroup, m.group()) for m in NUMBER.finditer(text)]
        found += [
            (m.start(), m.end(), "iban", m.group()) for m in IBAN.finditer(text) if int(
                "".join(str(int(c, 36)) for c in (lambda x: x[4:] + x[:4])(m.group().replace(" ", "")))
            ) % 97 == 1
        ]
    if any(h in text for h in SECRET_HEADS):
        found += [(m.start(), m.end(), "secret", m.group()) for m in SECRET.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m.group(1)) for m in NAMED_SECRET.finditer(text)]
    found += titled(text)
    out, at = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    names = [source for *_, kind, source in found if kind == "name"]
    return sorted(out + mentions(text, names, out)) if names else out


def identity(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("name", "email"):
        return text.lower()
    if kind == "phone":
        return re.sub(r"\D", "", text)[-10:]
    return re.sub(r"[ \-]", "", text) if kind in ("card", "ssn", "iban") else text


#: Further surrogates that are tried for an entity whose own was taken; then one gets a number.
TRIES = 100


def surrogated(text: str | None, made: Surrogates) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and for each its kind and place in the new text."""
    found = entities(text) if text else []
    out, at, size, log = [], 0, 0, []
    owner: dict[tuple[str, str], str] = {}
    for a, b, kind, source in found:
        same = identity(kind, source.partition("|")[2] if kind == "name" else source)
        new = made.of(kind, source)
        for k in range(TRIES):
            if owner.setdefault((kind, identity(kind, new)), same) == same:
                break
            new = made.other(k).of(kind, source)
        else:
            n = 2
            while owner.setdefault((kind, identity(kind, f"{new}{n}")), same) != same:
                n += 1
            new = f"{new}{n}"
        out += [text[at:a], new]
        size += a - at + len(new)
        log.append({"kind": kind, "begin": size - len(new), "end": size})
        at = b
    return ("".join([*out, text[at:]]) if found else text), log


def replace(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """docs with surrogates in its text, and with a column entities: array of kind, begin, end in the new text."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "entities")
    text = docs.columns.index(text_col)
    plain = docs.withColumn(text_col, F.col(text_col).cast("string"))
    all_names = [*plain.columns, name]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            for part in pieces(batch, text):
                done = [surrogated(t, made) for t in part.column(text).to_pylist()]
                columns = part.columns
                columns[text] = pa.array([t for t, _ in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([e for _, e in done], kind)], names=all_names)

    return plain.mapInArrow(
        run,
        T.StructType([*plain.schema.fields, T.StructField(name, T._parse_datatype_string("array<struct<kind:string,begin:int,end:int>>"))]),
    )


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace(docs)
    return out.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_entities"),
        F.transform("entities", lambda e: e["kind"]).alias("kinds"),
        "text",
    )
