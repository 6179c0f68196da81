"""PII surrogates: detected entities are replaced by keyed, type-consistent stand-ins.

Detection covers e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers, IBANs, social security numbers,
secret tokens and names after a title or "my name is".  Such a name is carried over its whole text, to mentions without a
title before and behind; a name that the text also writes in lower case is not, as it may be a common word.
The same entity always gets the same surrogate (coreference), whatever the case or the separators of a mention; the mention's own case and separators are put back.

A surrogate is a keyed permutation of all strings of the entity's shape: letters stay letters of
their script, digits stay digits, a card keeps its check digit's validity, a private address stays private,
a given name moves inside the list of its gender and script.  A permutation maps distinct entities to
distinct surrogates and none to itself; what remains possible is that a surrogate equals another entity of the corpus.
``resolve`` finds those over the whole corpus, gives them the next permutation, and repeats until no
surrogate is shared and none is an entity; the few changed entities travel to their documents by a join.

Defined cases: null texts stay null, texts without entities stay as they are byte for byte, repeated rows get
equal results, extra columns pass through (one named like an output is replaced), a null id is allowed.
Detection reads whole texts.  Letters of scripts without a table here are kept; digits of every script are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from slatewise.llm.joins import BROADCAST_IDS
from slatewise.llm.text import blocks
from slatewise.session import stored

# Letters of each script that surrogates are drawn from.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"

# Titles with the gender they say, and given names by script and gender.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Sr": "m", "Señor": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Sra": "f", "Señora": "f", "Госпожа": "f",
    "Dr": "", "Prof": "",
}
GIVEN = {
    "m": (
        ("adam", "albert", "andrew", "anthony", "carlos", "charles", "daniel", "david", "edward", "eric", "frank", "george", "hans", "henry", "jack", "james", "john", "joseph", "louis", "luke",
         "mark", "martin", "michael", "oliver", "oscar", "paul", "peter", "pierre", "robert", "samuel", "simon", "stefan", "thomas", "victor", "walter", "william"),
        ("александр", "алексей", "андрей", "борис", "виктор", "дмитрий", "иван", "михаил", "николай", "олег", "павел", "сергей"),
    ),
    "f": (
        ("alice", "amelia", "anna", "barbara", "carla", "caroline", "charlotte", "clara", "diana", "elena", "elizabeth", "emily", "emma", "eva", "grace", "hannah", "helen", "ingrid", "jane", "julia",
         "karen", "laura", "linda", "lucy", "maria", "martha", "mary", "nina", "olivia", "paula", "rachel", "rosa", "sarah", "sofia", "susan", "victoria"),
        ("анна", "вера", "галина", "екатерина", "елена", "ирина", "мария", "наталья", "ольга", "светлана", "софия", "татьяна"),
    ),
}

_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]*(?:['’\-][^\W\d_]+)*"
PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({_NAME}(?: {_NAME}){{0,2}})")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]+@(?:[\w\-]+\.)+[^\W\d_]{2,})"
    r"|(?<![A-Za-z0-9_])(?:"
    r"(?P<secret>[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9\-_]{16,})"
    rf"|(?P<ip>(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}|(?<!\d )(?!000|666|9)\d{3} (?!00)\d{2} (?!0000)\d{4}(?! \d))"
    r"|(?P<card>(?<![.,\-+])\d(?:[ \-]?\d){12,18})"
    r"|(?P<phone>(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|\+\d{8,15}|(?:\+\d{1,3}[ .\-])(?:\d{2,4}[ .\-]?){3,5})"
    r")(?![A-Za-z0-9_])"
)
IBAN = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
NAMED = re.compile(rf"(?<!\w)[Mm]y name is ({_NAME}(?: {_NAME}){{0,2}})")
WORD = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(rf"(?<!\w){_NAME}(?!\w)")
MARKS = (*TITLES, "y name is")
SPARE = 4  # a shape is checked against the corpus while a quarter of its strings are taken at most


class Keyed:
    """Keyed permutations of shaped strings."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A permutation of range(size) in one cycle, so that from two values on none maps to itself.

        Another permutation, a balanced Feistel network walked until it falls into the range, gives the cycle's order.
        """
        if size < 2:
            return value
        return self._walk((self._walk(value, size, tweak, range(8)) + 1) % size, size, tweak, range(7, -1, -1))

    def _walk(self, value: int, size: int, tweak: str, turns: range) -> int:
        """The network's permutation of range(size), or with the turns in reverse its inverse."""
        half = max(1, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            left, right = (value >> half, value & mask) if turns.step > 0 else (value & mask, value >> half)
            for turn in turns:
                mixed = hashlib.blake2b(f"{tweak}|{turn}|{half}|{right}".encode(), key=self.key, digest_size=max(8, half // 8 + 1)).digest()
                left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
            value = left << half | right if turns.step > 0 else right << half | left
            if value < size:
                return value

    def shaped(self, text: str, tweak: str, alphabets: tuple[str, ...] = ALPHABETS, accept: Callable[[str], bool] = lambda _: True) -> str:
        """Another string with the same class at every place; `accept` closes a subset under the permutation."""
        classes = [_class(c, alphabets) for c in text]
        size = 1
        for letters in classes:
            size *= len(letters) if letters else 1
        value = 0
        for c, letters in zip(text, classes, strict=True):
            if letters:
                value = value * len(letters) + _place(c, letters)
        tweak = f"{tweak}|{text if not size else ''.join('·' if x else c for c, x in zip(text, classes, strict=True))}"
        while True:
            value = self.permute(value, size, tweak)
            rest, out = value, []
            for c, letters in zip(reversed(text), reversed(classes), strict=True):
                if letters:
                    rest, i = divmod(rest, len(letters))
                    out.append(letters[i] if isinstance(letters, str) else chr(letters[i]))
                else:
                    out.append(c)
            made = "".join(reversed(out))
            if accept(made):
                return made


def _class(c: str, alphabets: tuple[str, ...]) -> str | range | None:
    for letters in alphabets:
        if c in letters:
            return letters
    if c.isdecimal():
        return range(ord(c) - int(c), ord(c) - int(c) + 10)
    return next((range(a, b + 1) for a, b in RANGES if a <= ord(c) <= b), None)


def _place(c: str, letters: str | range) -> int:
    return letters.index(c) if isinstance(letters, str) else ord(c) - letters[0]


def luhn_offset(digits: str) -> int:
    """How far the last digit is from the one that the check asks for."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits[:-1])))
    return (int(digits[-1]) + total) % 10


def private(address: str) -> str:
    """The leading part that makes an address private or local, if any."""
    a, b = address.split(".")[:2]
    if a in ("10", "127", "0"):
        return f"{a}."
    if (a, b) in (("192", "168"), ("169", "254")) or a == "172" and 16 <= int(b) <= 31:
        return f"{a}.{b}."
    return ""


def surrogate(keyed: Keyed, kind: str, entity: str, turn: int = 0) -> str:
    """The stand-in of a canonical entity; `turn` numbers the permutations of a kind."""
    tweak = f"{kind}|{turn}"
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return keyed.shaped(f"{local}@{host}", tweak) + f".{top}"
    if kind == "ip":
        kept = private(entity)
        free = [int(x) for x in entity.removeprefix(kept).split(".")]
        value = int.from_bytes(bytes(free), "big")
        while True:
            value = keyed.permute(value, 256 ** len(free), f"{tweak}|{kept}")
            made = kept + ".".join(map(str, value.to_bytes(len(free), "big")))
            if private(made) == kept:
                return made
    if kind == "ip6":
        return _address(keyed, entity, tweak)
    if kind == "iban":
        body = keyed.shaped(entity[4:], f"{tweak}|{entity[:2]}")
        return f"{entity[:2]}{98 - _mod97(body + entity[:2] + '00'):02}{body}"
    if kind == "card":
        body = entity[0] + keyed.shaped(entity[1:-1], f"{tweak}|{entity[0]}")
        off = luhn_offset(entity)
        zero = ord(entity[-1]) - int(entity[-1])
        return next(body + chr(zero + d) for d in range(10) if luhn_offset(body + chr(zero + d)) == off)
    if kind in ("phone", "ssn"):
        kept, rest = ("1", entity[1:]) if kind == "phone" and len(entity) == 11 and entity[0] == "1" else (entity[:2], entity[2:]) if len(entity) > 11 else ("", entity)
        return kept + keyed.shaped(rest, f"{tweak}|{kept}", ("01", "23456789"))
    if kind == "secret":
        prefix = re.match(r"(?:akia|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_])?", entity)[0]
        hexed = not prefix and re.fullmatch("[0-9a-f]+", entity)
        return prefix + keyed.shaped(entity[len(prefix) :], f"{tweak}|{prefix}", ("0123456789abcdef",) if hexed else ALPHABETS)
    if kind.startswith("given "):
        names = next(x for x in GIVEN[kind[-1]] if entity in x)
        return names[keyed.permute(names.index(entity), len(names), tweak)]
    return keyed.shaped(entity, tweak, (VOWELS, CONSONANTS, *ALPHABETS), lambda x: not any(x in names for lists in GIVEN.values() for names in lists))


def shape(kind: str, entity: str) -> tuple[str, int]:
    """What the surrogates of an entity have in common with it, and how many strings share that."""
    if kind.startswith("given "):
        names = next(x for x in GIVEN[kind[-1]] if entity in x)
        return names[0], len(names)
    if kind == "ip":
        kept = private(entity)
        return kept, 256 ** (4 - kept.count("."))
    if kind == "ip6":
        groups = entity.split(":")
        return ":".join("0" if int(g, 16) == 0 else "x" for g in groups), 65535 ** max(1, sum(int(g, 16) > 0 for g in groups) - 1)
    alphabets = (VOWELS, CONSONANTS, *ALPHABETS) if kind == "name" else ("0123456789abcdef", *ALPHABETS) if kind == "secret" else ("01", "23456789") if kind in ("phone", "ssn") else ALPHABETS
    if kind == "iban":
        entity = f"{entity[:2]}00{entity[4:]}"
    fixed = {"card": (0, -1), "iban": (0, 1, 2, 3)}.get(kind, ())
    out, size = [], 1
    for i, c in enumerate(entity):
        letters = _class(c, alphabets) if i not in fixed and i - len(entity) not in fixed else None
        out.append(str(letters[0]) if letters else c)
        size *= len(letters) if letters else 1
    return "".join(out), size


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _local(group: int) -> bool:
    """Whether a first group of 16 bits makes an address link-local or unique local."""
    return group >> 6 == 0xFE80 >> 6 or group >> 9 == 0xFC00 >> 9


def _address(keyed: Keyed, entity: str, tweak: str) -> str:
    """Groups of zeros stay, as does the first group of a local address; the others are permuted together."""
    groups = [int(g, 16) for g in entity.split(":")]
    free = [i for i, g in enumerate(groups) if g and not (i == 0 and _local(g))]
    value = 0
    for i in free:
        value = value * 65535 + groups[i] - 1
    tweak = f"{tweak}|{''.join('x' if i in free else f'{g:04x}' for i, g in enumerate(groups))}"
    while True:
        value = rest = keyed.permute(value, 65535 ** len(free), tweak)
        for i in reversed(free):
            rest, low = divmod(rest, 65535)
            groups[i] = low + 1
        if 0 not in free or not _local(groups[0]):
            return ":".join(f"{g:04x}" for g in groups)


def _low(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity share: digits of numbers, lower case of the rest."""
    if kind == "ip6":
        return IPv6Address(mention).exploded
    if kind == "iban":
        return mention.replace(" ", "").lower()
    return "".join(c for c in mention if c.isdecimal()) if kind in ("phone", "card", "ssn") else _low(mention)


def dressed(kind: str, mention: str, made: str) -> str:
    """A surrogate in the separators and the case of a mention."""
    if kind == "ip6":
        made = made if len(mention) == 39 else str(IPv6Address(made))
        return made.upper() if mention.isupper() else made
    if kind == "iban":
        letters = iter(made.upper())
        return "".join(next(letters) if c != " " else c for c in mention)
    if kind in ("phone", "card", "ssn"):
        digits = iter(made)
        return "".join(next(digits) if c.isdecimal() else c for c in mention)
    if len(made) != len(mention):
        return made.capitalize() if mention[:1].isupper() and not mention.isupper() else made.upper() if mention.isupper() else made
    return "".join(up if m.isupper() and len(up := c.upper()) == 1 else c for c, m in zip(made, mention, strict=True))


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) of every mention, in order and without overlaps.

    A name found after a title counts wherever it stands in the text with a capital, alone or behind a listed given name,
    unless the text also has it in lower case: then it is taken for a common word.
    """
    found = [(m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])) for m in ENTITY.finditer(text)]
    found += [(m.start(), m.end(), "iban", canonical("iban", m[0])) for m in IBAN.finditer(text) if _is_iban(m[0])]
    found += [(m.start(), m.end(), "ip6", canonical("ip6", m[0])) for m in IPV6.finditer(text) if _is_ip6(m[0])]
    persons = []
    for pattern, group in ((PERSON, 2), (NAMED, 1)):
        for m in pattern.finditer(text):
            gender, at = TITLES.get(m[1]) if group == 2 else None, m.start(group)
            for i, word in enumerate(m[group].split(" ")):
                low = _low(_bare(word))
                listed = next((g for g in ("m", "f") if g in (gender or "mf") and any(low in names for names in GIVEN[g])), None)
                persons.append((at, at + len(_bare(word)), f"given {listed}" if listed and i == 0 else "name", low))
                at += len(word) + 1
    out = _without_overlaps(found + persons)
    return sorted(out + _later(text, out, persons)) if persons else out


def _without_overlaps(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    out, last = [], 0
    for item in sorted(set(found), key=lambda x: (x[0], -x[1], x)):
        if item[0] >= last:
            out.append(item)
            last = item[1]
    return out


def _later(text: str, out: list[tuple[int, int, str, str]], persons: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names of a text, outside the mentions it has already."""
    kinds: dict[str, str] = {}
    for _, _, kind, low in sorted(persons):
        kinds.setdefault(low, kind)
    rest, last = [], 0
    for start, end, _, _ in out:
        rest.append(text[last:start])
        last = end
    common = {w for part in (*rest, text[last:]) for w in WORD.findall(part) if w[0].islower()}
    known = {low: kind for low, kind in kinds.items() if low not in common and len(low) > 1}
    starts = [start for start, _, _, _ in out]

    def untouched(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or out[at - 1][1] <= start

    more, before = [], None
    for m in CAPITAL.finditer(text):
        word = _bare(m[0])
        low = _low(word)
        if low in known and untouched(m.start(), m.start() + len(word)):
            more.append((m.start(), m.start() + len(word), known[low], low))
            if known[low] == "name" and before and before[1] + 1 == m.start() and text[before[1]] == " ":
                given = next((g for g in "mf" if any(before[2] in names for names in GIVEN[g])), None)
                if given and before[2] not in known and untouched(*before[:2]):
                    more.append((before[0], before[1], f"given {given}", before[2]))
        before = (m.start(), m.end(), low)
    return more


def _bare(word: str) -> str:
    """A name without the ending of its possessive."""
    return word[:-2] if len(word) > 3 and word[-2] in "'’" and word[-1] in "sS" else word


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


def _is_ip6(text: str) -> bool:
    """A valid address of three groups and a digit at least, or a short one of a well-known beginning."""
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdecimal() for c in text) and (sum(map(bool, text.split(":"))) > 2 or text[:4].lower() in ("fe80", "2001"))


def suspects(column: pa.Array) -> np.ndarray:
    """Rows that may hold a mention: a digit, an at sign, a secret's prefix or a title somewhere in the text."""
    out = np.zeros(len(column), bool)
    for a, b, data, offsets in blocks(column):
        hits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64), dtype=np.int64)])
        out[a:b] = np.diff(hits[offsets]) > 0
    for mark in (*MARKS, "sk-", "sk_", "pk_", "pk-", "gho_", "ghp_", "xoxb", "xoxp", "AKIA"):
        out |= pc.fill_null(pc.match_substring(column, mark), False).to_numpy(zero_copy_only=False)
    # other scripts' digits count as well
    return out | pc.fill_null(pc.match_substring_regex(column, r"[٠-٩۰-۹०-९０-９]"), False).to_numpy(zero_copy_only=False)


def _maker(key: bytes) -> Callable[[str, str, int], str]:
    keyed = Keyed(key)

    @lru_cache(maxsize=20_000)
    def made(kind: str, entity: str, turn: int) -> str:
        return surrogate(keyed, kind, entity, turn)

    return made


def entities_of(documents: DataFrame, text_col: str) -> DataFrame:
    """(kind, entity) of the whole corpus, each once."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            texts = column.filter(pa.array(suspects(column))).to_pylist()
            pairs = sorted({(kind, entity) for text in texts for _, _, kind, entity in mentions(text)})
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["kind", "entity"])

    return documents.select(text_col).mapInArrow(scanned, "kind string, entity string").distinct()


def resolve(entities: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, entity, turn) of entities that must not use their first surrogate; None if there are none.

    Of entities that share a surrogate the first keeps it, unless it is an entity itself.  Where the corpus holds more
    than a quarter of a shape's strings, as it does with given names, too few are left that nobody bears: there only
    sharing counts, which permutations rule out.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _maker(key)
        for batch in batches:
            rows = batch.to_pydict()
            out = [made(k, e, t) for k, e, t in zip(rows["kind"], rows["entity"], rows["turn"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "turn")), pa.array(out, pa.string())], names=["kind", "entity", "turn", "made"])

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            shapes = [shape(*x) for x in zip(rows["kind"], rows["entity"], strict=True)]
            cells = [pa.array([x[0] for x in shapes], pa.string()), pa.array([min(x[1], 2**62) for x in shapes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=["kind", "entity", "shape", "size"])

    schema = "kind string, entity string, turn int, made string"
    listed = stored(entities.mapInArrow(shaped, "kind string, entity string, shape string, size long"), "entities")
    taken = listed.groupBy("kind", "shape", "size").agg(F.count("*").alias("n"))
    known = stored(listed.join(taken, ["kind", "shape", "size"]).select("kind", "entity", (F.col("n") * SPARE <= F.col("size")).alias("real")), "known-entities")
    state = stored(known.select("kind", "entity", F.lit(0).alias("turn")).mapInArrow(drawn, schema), "surrogates")
    changed = False
    while True:
        taken = known.where("real").select("kind", F.col("entity").alias("made"), "real")
        shared = state.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("turn", "entity")).alias("keeper")).join(taken, ["kind", "made"], "left").where((F.col("n") > 1) | F.col("real"))
        clash = state.join(shared, ["kind", "made"]).where(F.coalesce("real", F.lit(False)) | (F.struct("turn", "entity") != F.col("keeper"))).select("kind", "entity", F.lit(1).alias("bump"))
        if clash.isEmpty():
            return state.where("turn > 0").select("kind", "entity", "turn") if changed else None
        changed = True
        state = stored(state.join(clash, ["kind", "entity"], "left").select("kind", "entity", (F.col("turn") + F.coalesce("bump", F.lit(0))).alias("turn")).mapInArrow(drawn, schema), "surrogates")


def replace_pii(documents: DataFrame, key: bytes, *, text_col: str = "text", count_col: str = "n_mentions") -> DataFrame:
    """All columns of `documents` with surrogates in the text, and the number of mentions replaced."""
    documents = documents.drop(count_col)
    turns = resolve(entities_of(documents, text_col), key)
    turn_col = _free("_surrogate_turns", documents)
    if turns is None:
        frame = documents.withColumn(turn_col, F.lit(None).cast("map<string,int>"))
    else:
        frame = _with_turns(documents, turns, text_col, turn_col)
    names = frame.columns
    at, turn_at = names.index(text_col), names.index(turn_col)
    kept = [i for i in range(len(names)) if i != turn_at]
    schema = StructType([*(StructField(text_col, StringType()) if i == at else frame.schema.fields[i] for i in kept), StructField(count_col, LongType())])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _maker(key)
        for batch in batches:
            column, counts = batch.column(at), np.zeros(batch.num_rows, np.int64)
            rows = np.flatnonzero(suspects(column))
            if len(rows):
                texts = column.to_pylist()
                for i in rows.tolist():
                    text, own = texts[i], dict(batch.column(turn_at)[i].as_py() or ())
                    parts, last = [], 0
                    found = mentions(text)
                    for start, end, kind, entity in found:
                        parts += [text[last:start], dressed(kind, text[start:end], made(kind, entity, own.get(f"{kind}\t{entity}", 0)))]
                        last = end
                    texts[i], counts[i] = "".join(parts) + text[last:] if found else text, len(found)
                column = pa.array(texts, pa.string())
            columns = [column if i == at else batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*(names[i] for i in kept), count_col])

    return frame.mapInArrow(rewritten, schema)


def _with_turns(documents: DataFrame, turns: DataFrame, text_col: str, turn_col: str) -> DataFrame:
    """Documents with the turns of those of their entities that changed; rows are matched by the text's hash pair."""
    marks = [F.xxhash64(text_col), F.crc32(F.col(text_col).cast("binary"))]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            out: dict[str, list] = {"_a": [], "_b": [], "kind": [], "entity": []}
            for i in np.flatnonzero(suspects(column)).tolist():
                for kind, entity in sorted({(k, e) for _, _, k, e in mentions(column[i].as_py())}):
                    for name, value in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), kind, entity), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["_a"], pa.int64()), pa.array(out["_b"], pa.int64()), pa.array(out["kind"], pa.string()), pa.array(out["entity"], pa.string())], names=list(out))

    pairs = documents.select(marks[0].alias("_a"), marks[1].alias("_b"), text_col).mapInArrow(listed, "_a long, _b long, kind string, entity string").distinct()
    changed = stored(pairs.join(turns, ["kind", "entity"]), "changed-mentions")
    a, b = _free("_a", documents), _free("_b", documents)
    by_text = changed.groupBy(F.col("_a").alias(a), F.col("_b").alias(b)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "kind", "entity"), "turn"))).alias(turn_col))
    few = changed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return documents.join(F.broadcast(by_text) if few else by_text, (marks[0] == F.col(a)) & (marks[1] == F.col(b)), "left").drop(a, b)


def _free(name: str, frame: DataFrame) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name
