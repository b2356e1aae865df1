"""Surrogates for personal data: keyed, of the same type, gender, script and format.

1. Detect entities in every text. Each gets a canonical form, so that one number written in two ways stays one entity.
2. Gather the distinct entities of the corpus and give each a surrogate by a keyed permutation of its kind (a
   Feistel network that walks on until the result is valid for the type) or, for names, a keyed pick
   from names of the same gender and script.
3. Check for collisions: a surrogate that is itself an entity of the corpus, or that two entities share, is drawn
   again for all but one of them, until none is left. So different entities stay different, and equal ones equal.
4. Rewrite the texts, each surrogate in the format of the mention it replaces.

Texts without an entity are never shuffled; texts with one are written to the shared folder once.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewall.session import cut_lineage

KEY = b"surrogates"  # a deployment passes its own secret
ATTEMPTS = 40

# --- fixed values: titles and given names by script and gender, endings of made-up names ---
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος", "κ."),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Pierre Hans Jürgen Carlos Luis Miguel Antoine Klaus",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Sandra Ashley Emily Marie Claire Ingrid Greta Carmen Lucía Isabel Hélène Anke",
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Андрей Михаил Николай Павел Олег",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Вера Юлия",
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Ανδρέας",
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Ιωάννα",
}
ENDINGS = {
    ("latin", "m"): ("o", "an", "ek", "ius"), ("latin", "f"): ("a", "ia", "elle", "ina"), ("latin", "n"): ("er", "son", "well", "ton", "ford"),
    ("cyrillic", "m"): ("ей", "ан", "ил"), ("cyrillic", "f"): ("а", "ия", "ина"), ("cyrillic", "n"): ("енко", "ук", "ских", "ян"),
    ("greek", "m"): ("ος", "ης", "ας"), ("greek", "f"): ("α", "η", "ω"), ("greek", "n"): ("ου", "άκη", "ίδη"),
}
SYLLABLES = {
    "latin": "ba be bi bo bra da del di dor fa fe gal ha hol ka kel la len lo ma mer mi mon na nor pa pel ra ren ro sa sel ta tor va ver wal",
    "cyrillic": "ба ве го да ка ла ле ло ма ми не но ра ре ро са та ти ви по",
    "greek": "βα γα δε κα λα λε μα μι νι πα ρο σα τε το φι",
}
# --- end of fixed values ---

GENDER_OF_TITLE = {t.lower(): g for g, ts in TITLES.items() for t in ts}
GENDER_OF_NAME = {n.lower(): g for (_, g), ns in GIVEN.items() for n in ns.split()}
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ", "a-zß-öø-ÿа-яёα-ωάέήίόύώς"
_INNER = rf"(?:(?!['’]s(?!\w))['’-]?[{_UP}]?[{_LOW}]++)"  # McDonald, O'Brien, Jean-Luc; an 's at the end is none of the name
_END = r"(?!\w|-\w|['’](?!s(?!\w))\w)"
_CAP = rf"[{_UP}]{_INNER}++{_END}"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted((n for ns in GIVEN.values() for n in ns.split()), key=len, reverse=True))
PERSON = re.compile(rf"(?<!\w)(?:(?P<title>(?i:{_TITLE}))\.?[  ])(?P<names>{_CAP}(?:[  ]{_CAP}){{0,2}})|(?<!\w)(?P<given>(?:{_GIVEN})(?:-[{_UP}][{_LOW}]++)?)[  ](?P<family>{_CAP})")
PATTERNS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("key", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("token", re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,39}[a-f])(?=[0-9a-f]{0,39}[0-9])[0-9a-f]{40}(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])")),
    ("ip6", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.[0-9])")),
    ("card", re.compile(r"(?<![\w.-])[3-6][0-9]{3}(?:(?P<s>[ -]?)[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}|[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w.])\+[0-9]{8,14}(?!\w)")),
)
# looked for where the patterns above find nothing; what is too long or fails its test loses its last groups
WIDE: tuple[tuple[str, re.Pattern], ...] = (
    ("card", re.compile(r"(?<![\w.-])(?:[2-68][0-9]{3}(?:[ -]?[0-9]){9,15}|1[0-9]{3}(?:[ -]?[0-9]){11})(?![\w-])")),  # with the Luhn test
    ("phone", re.compile(r"(?<![\w.])\+[0-9]{1,3}(?:(?:[ .-]?\([0-9]{1,4}\)[ .-]?|[ .-])[0-9]{1,8}){1,7}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?![0-3][0-9]([ .-])[0-3][0-9]\1[0-9]{4}(?![0-9]))(?:\(00?[1-9][0-9]{0,3}\)[ .-]?[0-9]{1,8}|00?[1-9][0-9]{0,3}[ .-][0-9]{1,8})(?:[ .-][0-9]{1,8}){0,6}(?![\w-])")),
)
# holds wherever detect() finds something
GATE = r"@|[0-9]{3}|[0-9]\.[0-9]+\.|:[0-9A-Fa-f]{0,4}:|AKIA|[0-9a-f]{40}|[A-Z]{2}[0-9]{2}|\+[0-9]|0[1-9]|(?:^|[^\pL\pN])(?i:" + _TITLE + r")\.?[ \x{00a0}]|(?:" + _GIVEN + r")[ \x{00a0}-]"
SPAN = "array<struct<start:int,end:int,kind:string,entity:string>>"


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_holds(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip6(raw: str) -> str | None:
    """An address in full, if it is one and not a word pair that happens to be spelt in a to f."""
    try:
        address = ipaddress.IPv6Address(raw)
    except ValueError:
        return None
    return None if address.is_loopback or address.is_unspecified or not any(c.isdigit() for c in raw) else address.exploded


def _script(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _canonical(kind: str, raw: str) -> str | None:
    """The form that all mentions of one entity share; None if the match is no such entity."""
    if kind == "email":
        return raw.lower()
    if kind in ("card", "ssn"):
        return _digits(raw)
    if kind == "phone":
        digits = _digits(raw)
        if not 7 <= len(digits) <= 15:
            return None
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "ip6":
        return _ip6(raw)
    if kind == "iban":
        plain = raw.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and _iban_holds(plain) else None
    return raw


def _trimmed(kind: str, raw: str) -> tuple[int, str] | None:
    """Length and canonical form of the longest run of a match's first groups that is such an entity."""
    while raw:
        entity = _canonical(kind, raw)
        if entity is not None and (kind != "card" or (13 <= len(entity) <= 19 and luhn(entity))):
            return len(raw), entity
        raw = raw[: max(raw.rfind(c) for c in " .-") if any(c in raw for c in " .-") else 0]
    return None


def _part_of(kind: str, raw: str, found: tuple) -> bool:
    """Whether an entity found inside a longer match is a piece of it, not one that stands for itself."""
    if kind == "card":
        return found[3] == "phone" or (found[3] == "card" and not luhn(found[4]))
    return found[3] == "phone" and raw[0] == "+" and not raw.startswith("+1")


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text, in order and without overlap: start, end, kind, canonical form.

    Of overlapping matches the one that starts first stays; of those that start together, the kind named first.
    """
    found: list[tuple[int, int, int, str, str]] = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            entity = _canonical(kind, m[0])
            if entity is not None:
                found.append((m.start(), rank, m.end(), kind, entity))
    for rank, (kind, pattern) in enumerate(WIDE, len(PATTERNS)):
        for m in pattern.finditer(text):
            if not (hit := _trimmed(kind, m[0])):
                continue
            lo, hi = m.start(), m.start() + hit[0]
            over = [f for f in found if f[2] > lo and f[0] < hi]
            if all(lo <= f[0] and f[2] <= hi and f[2] - f[0] < hi - lo and _part_of(kind, m[0], f) for f in over):
                found = [f for f in found if f not in over]
                found.append((lo, rank, hi, kind, hit[1]))
    for m in PERSON.finditer(text):
        gender = GENDER_OF_TITLE.get((m["title"] or "").lower().rstrip(".") , "n") if m["title"] else GENDER_OF_NAME[m["given"].split("-")[0].lower()]
        span = m.start("names") if m["title"] else m.start("given")
        names = re.split("[  ]", m["names"]) if m["title"] else [m["given"], m["family"]]
        for i, name in enumerate(names):
            own = GENDER_OF_NAME.get(name.split("-")[0].lower())
            is_given = len(names) > 1 and i < len(names) - 1
            kind = f"given_{own or gender}" if is_given else "family"
            found.append((span, len(PATTERNS) + len(WIDE), span + len(name), f"{kind}_{_script(name)}", name.lower()))
            span += len(name) + 1
    found.sort()
    out, free = [], 0
    for start, _, end, kind, entity in found:
        if start >= free:
            out.append((start, end, kind, entity))
            free = end
    return out


class Permutation:
    """A keyed permutation of the strings of one pattern: a Feistel network over mixed radices.

    ``radices`` gives the number of symbols at each place. The halves are numbers; each round adds a keyed digest of one to the other.
    """

    def __init__(self, radices: list[int], tweak: bytes, rounds: int = 8):
        half = len(radices) // 2
        self.radices = radices
        self.left, self.right = 1, 1
        for r in radices[:half]:
            self.left *= r
        for r in radices[half:]:
            self.right *= r
        self.tweak, self.rounds = tweak, rounds

    def _digest(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d" % (i, x), key=self.tweak, digest_size=32).digest(), "big")

    def __call__(self, symbols: list[int]) -> list[int]:
        half = len(symbols) // 2
        a = b = 0
        for s, r in zip(symbols[:half], self.radices[:half], strict=True):
            a = a * r + s
        for s, r in zip(symbols[half:], self.radices[half:], strict=True):
            b = b * r + s
        for i in range(self.rounds):
            if i % 2:
                a = (a + self._digest(i, b)) % self.left
            else:
                b = (b + self._digest(i, a)) % self.right
        out = []
        for x, radices in ((b, self.radices[half:]), (a, self.radices[:half])):
            for r in reversed(radices):
                x, s = divmod(x, r)
                out.append(s)
        return out[::-1]


def _tweak(key: bytes, *parts: object) -> bytes:
    return hashlib.blake2b("|".join(map(str, parts)).encode(), key=key[:64], digest_size=32).digest()


def _walk(step: Callable[[str], str], start: str, valid: Callable[[str], bool]) -> str:
    """Apply a permutation until the result is valid: a permutation of the valid strings, as the start is one."""
    x = step(start)
    while not valid(x):
        x = step(x)
    return x


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _same_pattern(s: str, tweak: bytes, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """Permutes the symbols of a string within their alphabets; other characters and the pattern stay."""
    places = [(i, next(a for a in alphabets if c in a)) for i, c in enumerate(s) if any(c in a for a in alphabets)]
    if not places:
        return s
    pattern = "".join(str(next((k for k, a in enumerate(alphabets) if c in a), c)) for c in s)
    moved = Permutation([len(a) for _, a in places], hashlib.blake2b(pattern.encode(), key=tweak, digest_size=32).digest())([a.index(s[i]) for i, a in places])
    out = list(s)
    for (i, a), m in zip(places, moved, strict=True):
        out[i] = a[m]
    return "".join(out)


def _ip_class(s: str) -> tuple:
    a = ipaddress.IPv4Address(s)
    return a.is_private, a.is_loopback, a.is_multicast, a.is_reserved, a.is_link_local


def _made_up(script: str, gender: str, draw: np.random.Generator, syllables: int) -> str:
    parts = [str(draw.choice(SYLLABLES[script].split())) for _ in range(syllables)]
    return "".join(parts) + str(draw.choice(ENDINGS[script, gender]))


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of an entity; each attempt is another keyed draw of the same kind."""
    tweak = _tweak(key, kind, attempt)
    step = lambda s: _same_pattern(s, tweak)
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_same_pattern(local, tweak)}@{_same_pattern(host, _tweak(key, 'host', attempt))}.{top}"
    if kind == "card":
        fixed, rest = entity[0], entity[1:]
        if luhn(entity):  # the check digit follows from the others
            body = step(rest[:-1])
            return next(fixed + body + c for c in "0123456789" if luhn(fixed + body + c))
        return fixed + _walk(step, rest, lambda x: not luhn(fixed + x))
    if kind == "ssn":
        real = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return _walk(step, entity, real) if real(entity) else step(entity)
    if kind == "phone":
        north = lambda x: len(x) == 10 and x[0] in "23456789" and x[3] in "23456789"
        if entity[0] == "0" and entity[1] != "0":  # a trunk prefix stays one
            return "0" + _walk(step, entity[1:], lambda x: x[0] != "0")
        return _walk(step, entity, north) if north(entity) else entity[0] + step(entity[1:])
    if kind == "ip":
        octets = [int(o) for o in entity.split(".")]
        own = _ip_class(entity)
        fixed = 2 if own[4] else 1 if own[1] else 0  # rare ranges keep what makes them
        perm = Permutation([256] * (4 - fixed), tweak)
        move = lambda s: ".".join(map(str, octets[:fixed] + perm([int(o) for o in s.split(".")][fixed:])))
        return _walk(move, entity, lambda x: _ip_class(x) == own)
    if kind == "ip6":  # the first group says what kind of address it is, and groups of zeros stay
        groups = entity.split(":")
        own = [i for i in range(1, 8) if groups[i] != "0000"]
        moved = _same_pattern("".join(groups[i] for i in own), tweak, ("0123456789abcdef",))
        for k, i in enumerate(own):
            groups[i] = moved[4 * k : 4 * k + 4]
        return ":".join(groups)
    if kind == "iban":
        body = step(entity[4:])
        for check in range(2, 99):
            if _iban_holds(f"{entity[:2]}{check:02d}{body}"):
                return f"{entity[:2]}{check:02d}{body}"
    if kind == "key":
        both = (ALPHABETS[2] + ALPHABETS[0],)
        return "AKIA" + _same_pattern(entity[4:], tweak, both)
    if kind == "token":
        return _same_pattern(entity, tweak, ("0123456789abcdef",))
    role, *gender, script = kind.split("_")
    draw = np.random.Generator(np.random.PCG64(int.from_bytes(_tweak(key, kind, entity, attempt), "big")))
    g = gender[0] if gender else "n"
    if role == "given" and attempt == 0:
        names = " ".join(ns for (sc, ge), ns in GIVEN.items() if sc == script and g in (ge, "n")).split()
        return str(draw.choice(names)).lower()
    return _made_up(script, g, draw, 2 + min(attempt // 3, 6))


def formatted(raw: str, kind: str, entity: str, new: str) -> str:
    """The surrogate written as the mention was: its separators, its case, its prefix."""
    if kind in ("card", "ssn", "phone", "iban"):
        shown = "".join(c for c in raw if c.isalnum())
        symbols = iter(shown[: len(shown) - len(new)] + new)  # a country code in front stays
        return "".join(next(symbols) if c.isalnum() else c for c in raw)
    if kind == "email":
        if raw.islower():
            return new
        return "".join(n.upper() if r.isupper() else n for r, n in zip(raw, new, strict=True))
    if kind == "ip6":
        shown = new if len(raw) == len(new) else ipaddress.IPv6Address(new).compressed
        return shown.upper() if raw.isupper() else shown
    if kind.startswith(("given", "family")):
        return new.upper() if raw.isupper() else new.capitalize()
    return new


def _find(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("_text")
        gate = pc.fill_null(pc.match_substring_regex(text, GATE), False)
        spans: list = [None] * len(text)
        for i in np.flatnonzero(gate.to_numpy(zero_copy_only=False)).tolist():
            spans[i] = detect(text[i].as_py()) or None
        has = pa.array([s is not None for s in spans])
        if not want:
            out = batch.filter(pc.invert(has))
            yield pa.RecordBatch.from_arrays([out.column("_row"), out.column("_text")], names=["_row", "_text"])
            continue
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
        out = batch.filter(has)
        rows = [[dict(zip(("start", "end", "kind", "entity"), s, strict=True)) for s in ss] for ss in spans if ss is not None]
        yield pa.RecordBatch.from_arrays([out.column("_row"), out.column("_text"), pa.array(rows, kind)], names=["_row", "_text", "_spans"])


def _drawn(key: bytes, attempt: int):
    @F.pandas_udf("string")
    def draw(kind, entity):
        import pandas as pd

        return pd.Series([surrogate(k, e, attempt, key) for k, e in zip(kind, entity, strict=True)], dtype=object)

    return draw


def vault(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity, surrogate for every distinct entity: no surrogate is an entity of its kind, and no two are equal.

    ``entities``: kind, entity; repeated rows count once, rows with a null are left out. Attempts are made until no
    collision is left; each attempt handles only the entities still without a surrogate.
    """
    space = F.regexp_extract("kind", "^[a-z]+", 0)
    known = cut_lineage(entities.where(F.col("kind").isNotNull() & F.col("entity").isNotNull()).select("kind", "entity").distinct().withColumn("_space", space))
    taken = known.select("_space", F.col("entity").alias("surrogate"))
    open_, done = known, None
    for attempt in range(ATTEMPTS):
        drawn = cut_lineage(open_.select("kind", "entity", "_space", _drawn(key, attempt)("kind", "entity").alias("surrogate")))
        fresh = drawn.join(taken, ["_space", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("_space", "surrogate"), ["_space", "surrogate"], "left_anti")
        first = fresh.groupBy("_space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("_own"))
        good = first.select("_own.kind", "_own.entity", "_space", "surrogate")
        done = cut_lineage(good if done is None else done.unionByName(good))
        open_ = cut_lineage(drawn.select("kind", "entity", "_space").join(done, ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return done.select("kind", "entity", "surrogate")
    raise RuntimeError("some entities found no free surrogate: their kind has too few forms")


def _rewriter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_new").to_pylist(), strict=True):
            out, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                out += (text[at : s["start"]], formatted(text[s["start"] : s["end"]], s["kind"], s["entity"], s["surrogate"]))
                at = s["end"]
            texts.append("".join([*out, text[at:]]))
            counts.append(len(spans))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["_row", "_text", "_n"])


def pseudonymise(df: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """All rows and columns of ``df`` with ``text`` rewritten and ``n_entities`` (replaced mentions) added.

    A null text stays null with 0 entities; an empty table gives no row. Repeated rows are rewritten each. Columns
    named n_entities are replaced. The same entity gets the same surrogate in every text of the call and, but for
    collisions, in every call with the same key.
    """
    keep = [c for c in df.columns if c != "n_entities"]
    named = df.select(F.struct(*(c for c in keep if c != text), F.lit(0).alias("_")).alias("_row"), F.col(text).alias("_text"))
    row = named.schema["_row"].dataType
    pair = T.StructType([T.StructField("_row", row), T.StructField("_text", T.StringType())])
    spans = T.StructType([*pair.fields, T.StructField("_spans", T._parse_datatype_string(SPAN))])
    hits = cut_lineage(named.mapInArrow(lambda b: _find(b, True), spans).withColumn("_id", F.monotonically_increasing_id()))
    mentions = hits.select("_id", F.explode("_spans").alias("_s")).select("_id", "_s.*")
    names = vault(mentions.select("kind", "entity"), key)
    new = mentions.join(names, ["kind", "entity"]).groupBy("_id").agg(F.collect_list(F.struct("start", "end", "kind", "entity", "surrogate")).alias("_new"))
    out = T.StructType([*pair.fields, T.StructField("_n", T.IntegerType())])
    changed = hits.select("_id", "_row", "_text").join(new, "_id").select("_row", "_text", "_new").mapInArrow(_rewriter, out)
    plain = named.mapInArrow(lambda b: _find(b, False), pair).withColumn("_n", F.lit(0))
    both = changed.unionByName(plain)
    cols = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in keep]
    return both.select(*cols, F.col("_n").cast("int").alias("n_entities"))

