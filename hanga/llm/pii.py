"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Detection finds e-mail addresses, IPv4 addresses, phone numbers, long account
and card numbers, SSN-like numbers, IBANs, secrets, and personal names (after
a title, or a known given name before a capitalised name). A surrogate is a
keyed function (HMAC) of the entity's kind and normal form only, so one entity
gets one surrogate in every document, whatever its spelling there; it is
rendered in the mention's own format: digits for digits, the country prefix
kept, Luhn and IBAN check digits recomputed when the original had valid ones,
hex for hex, upper case for upper case, a name of the same gender and script
with as many parts. The last word of a name is its surname, an entity of its
own: "John Smith" and "Mr Smith" get the same one.

Collision checks. Over the whole corpus two different entities must not share
a surrogate, and no surrogate may equal a real entity; numbers and secrets are
compared across their kinds, by letters and digits alone, so a phone's
surrogate is no real account number in another format. Entities that lose such
a clash (the smallest keeps its surrogate) are drawn again with a counter,
until none is left. Small spaces (surnames, private addresses, short phone
numbers) can fill up, so later draws are from larger ones: more syllables or
digits, other address ranges, the symbols of a secret replaced too. Only
redrawn entities travel to the rewriting pass; everything else is
recomputed from the key, so documents are read twice and never shuffled unless
the list of exceptions outgrows the broadcast limit.

Defined results: a null text stays null and an empty one empty, with no
entities; repeated rows are rewritten alike; null ids take part; extra columns
are kept; overlapping detections go to the kind listed first; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shared_table, shielded, small_side, text_key

TEST_KEY = "surrogate-key-1"   # public: for test tables only
NUMBERS = ("phone", "ssn", "account", "iban", "secret")   # told apart by letters and digits only
MAX_ROUNDS = 100
GIVEN_ROUNDS = 4          # draws of a given name before it gets longer
WORD_ROUNDS = 2           # draws per syllable that a surname gets longer by
DIGIT_ROUNDS = 8          # draws per digit that a number gets longer by
RANGE_ROUNDS = 8          # draws before an address leaves its range
SYMBOL_ROUNDS = 4         # draws before the symbols of a secret are replaced too

# Titles by the gender they tell, given names by script and
# gender, and syllables that surnames are built from.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Sir", "господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Signora", "госпожа", "Κυρία"],
    "": ["Dr", "Prof", "Doctor", "Professor", "доктор"],
}
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Peter", "Paul",
                     "Hans", "Karl", "Pierre", "Jean", "Carlos", "José", "Luis"],
    ("latin", "f"): ["Mary", "Anna", "Linda", "Susan", "Sarah", "Laura", "Emma", "Julia", "Maria", "Marie",
                     "Claire", "Sophie", "Ingrid", "Greta", "Carmen", "Lucía"],
    ("cyrillic", "m"): ["Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
}
SYLLABLES = {
    "latin": ["bar", "cor", "den", "fal", "gor", "hal", "ken", "lan", "mor", "nor", "pel", "ran", "sel",
              "tor", "val", "wes"],
    "cyrillic": ["бар", "вол", "гор", "дар", "кол", "лан", "мор", "нов", "пет", "род", "сав", "тар", "фед",
                 "хар", "чер", "шар"],
    "greek": ["βαρ", "γαλ", "δημ", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαρ", "ταρ", "φιλ", "χαρ",
              "ψαλ", "ζαχ", "θεο"],
}
ENDINGS = {("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ης", ("greek", "f"): "η"}

# Names: words with inner hyphens and apostrophes (a possessive 's stays
# outside). Three words after a title may be of a script without case; any
# number of words that begin with a capital follow.
_INNER = r"(?:-[^\W\d_]+|['’](?![sS]\b)[^\W\d_]+)"
_REST = rf"(?:[^\W\d_]+|{_INNER}){_INNER}*"
_CAP = rf"[^\W\d_a-zа-яα-ωß-öø-ÿ]{_REST}"
_UPPER = "[" + "".join(c for c in map(chr, range(0x2000)) if c.isupper() or c.istitle()) + "]"
_MORE = rf"(?:[ \t]{_UPPER}{_REST})*"
_NAMES = rf"{_CAP}(?:[ \t]{_CAP}){{0,2}}{_MORE}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE_WORDS = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
_GIVEN_WORDS = "|".join(sorted({n for v in GIVEN.values() for n in v}, key=len, reverse=True))
# Detection order is precedence; group 1, if any, is the entity.
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*"
                          r"[\"']?([A-Za-z0-9_\-+/=]{8,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])((?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128})(?![0-9A-Za-z])")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ipv4", re.compile(rf"(?<![\w.])({_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\d)")),
    ("phone", re.compile(r"(?<![\w+])(\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("account", re.compile(r"(?<![\w.])(\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?![\w]|\.\d)")),
    ("name", re.compile(rf"\b(?:{_TITLE_WORDS})\b\.?[ \t]+({_NAMES})")),
    ("name", re.compile(rf"\b((?:{_GIVEN_WORDS})(?:-[^\W\d_]+)*[ \t]{_CAP}{_MORE})")),
]
# A kind is looked for only in texts that hold one of these characters or words.
_DIGIT = re.compile(r"\d")
_TITLE = re.compile(rf"\b(?:{_TITLE_WORDS}|{_GIVEN_WORDS})\b")
_WANTS: dict[str, Callable[[str], bool]] = {
    "email": lambda t: "@" in t,
    "name": lambda t: _TITLE.search(t) is not None,
}


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(norm: str) -> bool:
    return int("".join(str(int(c, 36)) for c in norm[4:] + norm[:4])) % 97 == 1


def _script(word: str) -> str:
    c = ord(next((x for x in word if x.isalpha()), "a"))
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


_GENDER_OF = {n.casefold(): g for (_, g), v in GIVEN.items() for n in v}
_GENDER_OF_TITLE = {t: g for g, v in TITLES.items() for t in v}


def _gender_of(given: str) -> str:
    return _GENDER_OF.get(given.casefold().partition("-")[0], "")


def normal_form(kind: str, value: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("email", "secret"):
        return value.lower()
    if kind in ("phone", "ssn", "account"):
        return ("+" if value.startswith("+") else "") + "".join(filter(str.isdigit, value))
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        return " ".join(value.split()).casefold()
    return value


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of the entities of a text, without overlaps,
    in order. The detail of a name is its gender (m, f or empty)."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray()
    for kind, pattern in PATTERNS:
        want = _WANTS.get(kind)
        if not (want(text) if want else digits or kind == "secret"):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if pattern.groups else m.span()
            covered = covered or bytearray(len(text))
            if any(covered[a:b]):
                continue
            covered[a:b] = b"\1" * (b - a)
            detail = ""
            if kind == "name":
                title = m.group()[:a - m.start()].strip(" \t.")
                detail = _GENDER_OF_TITLE.get(title, "") or _gender_of(text[a:b].split()[0])
            taken.append((a, b, kind, detail))
    return sorted(taken)


def surname_of(norm: str) -> str:
    return norm.rpartition(" ")[2]


def entities(text: str | None, hits: list[tuple[int, int, str, str]]) -> dict[tuple[str, str], str]:
    """(kind, normal form) -> detail (of its first mention) of the entities of
    a text. A name gives its surname, whose gender counts only where surnames
    have endings, and, with more words, the whole name."""
    found: dict[tuple[str, str], str] = {}
    for a, b, kind, detail in hits:
        norm = normal_form(kind, text[a:b])
        if kind == "name":
            last = surname_of(norm)
            found.setdefault(("surname", last), detail if (_script(last), "m") in ENDINGS else "")
            if last == norm:
                continue
        found.setdefault((kind, norm), detail)
    return found


class _Stream:
    """Keyed stream of small numbers."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        """Number in [0, n), n up to 256, without bias."""
        while True:
            if not self.pool:
                self.pool = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
                self.block += 1
            b, self.pool = self.pool[0], self.pool[1:]
            if b < 256 - 256 % n:
                return b % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def word(self, script: str, syllables: int) -> str:
        return "".join(SYLLABLES[script][self.below(len(SYLLABLES[script]))] for _ in range(syllables))


def _country_digits(norm: str) -> int:
    """Digits of a phone's country code (1 and 7 are whole codes)."""
    return 0 if not norm.startswith("+") else 1 if norm[1:2] in ("1", "7") else 2


def surrogate(kind: str, norm: str, detail: str, attempt: int, key: bytes) -> str:
    """Normal form of the surrogate of an entity."""
    rnd = _Stream(key, kind, norm, attempt)
    if kind == "email":
        domain = _Stream(key, "domain", norm.rpartition("@")[2])
        return f"{rnd.word('latin', 4 + attempt // DIGIT_ROUNDS)}{rnd.digits(4)}@{domain.word('latin', 5)}.example.net"
    if kind == "ipv4":
        parts = norm.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] in (["192", "168"], ["169", "254"]) else 0
        first = [str(1 + rnd.below(223))] if not keep else parts[:keep]
        if attempt >= 2 * RANGE_ROUNDS:      # reserved, never in use
            first = [str(240 + rnd.below(16))]
        elif attempt >= RANGE_ROUNDS and keep == 2:
            first = ["10"]
        return ".".join(first + [str(rnd.below(256)) for _ in range(4 - len(first))])
    if kind in ("phone", "ssn", "account"):
        keep = 1 + _country_digits(norm) if norm.startswith("+") else 0
        body = rnd.digits(len(norm) - keep + attempt // DIGIT_ROUNDS)
        out = norm[:keep] + body
        if kind == "account" and luhn_ok(norm):
            out = next(out[:-1] + str(d) for d in range(10) if luhn_ok(out[:-1] + str(d)))
        return out
    if kind == "iban":
        body = "".join(str(rnd.below(10)) if c.isdigit() else chr(65 + rnd.below(26)) for c in norm[4:])
        if not iban_ok(norm):
            return norm[:2] + rnd.digits(2) + body
        rest = int("".join(str(int(c, 36)) for c in body + norm[:2]) + "00") % 97
        return f"{norm[:2]}{98 - rest:02d}{body}"
    if kind == "secret":
        hexes = all(c in "0123456789abcdef" for c in norm)
        letters = "abcdef" if hexes else "abcdefghijklmnopqrstuvwxyz"
        mixed = "0123456789" + letters
        return "".join(mixed[rnd.below(len(mixed))] if c.isalnum() or attempt >= SYMBOL_ROUNDS else c
                       for c in norm)
    if kind == "surname":
        script = _script(norm)
        gender = detail or ("m", "f")[rnd.below(2)]
        return (rnd.word(script, 4 + attempt // WORD_ROUNDS) + ENDINGS.get((script, gender), "")).casefold()
    # a whole name: given names before the (first) surrogate of its surname,
    # which is replaced by the assigned one (``full_name``)
    parts = norm.split(" ")
    script = _script(norm)
    gender = detail or _gender_of(parts[0]) or ("m", "f")[rnd.below(2)]
    given = GIVEN[(script, gender)]
    first = given[rnd.below(len(given))]
    if attempt >= GIVEN_ROUNDS:   # more people of one surname than given names
        first += rnd.word(script, 1 + (attempt - GIVEN_ROUNDS) // 2)
    middle = [rnd.word(script, 3) for _ in parts[2:]]
    return " ".join([first, *middle, surrogate("surname", parts[-1], "m", 0, key)]).casefold()


def full_name(value: str, surname: str) -> str:
    """A whole name's surrogate with the surrogate of its surname."""
    return f"{value.rpartition(' ')[0]} {surname}"


def render(kind: str, mention: str, norm: str, value: str) -> str:
    """The surrogate ``value`` (a normal form) in the mention's own format."""
    if kind in ("phone", "ssn", "account", "iban"):
        rest = iter(value.lstrip("+") if kind != "iban" else value)
        return "".join([*(next(rest) if c.isalnum() else c for c in mention), *rest])
    if kind == "name":
        if mention.isupper():
            return value.upper()
        return " ".join(w[:1].upper() + w[1:] for w in value.split(" "))
    if kind in ("email", "secret"):
        letters = [c for c in mention if c.isalpha()]
        if letters and all(c.isupper() for c in letters):
            return value.upper()
        if kind == "secret" and any(c.isupper() for c in letters):
            return "".join(v.upper() if m.isupper() else v for v, m in zip(value, mention, strict=True))
        return value
    return value


_ENTITY = "kind string, norm string, detail string"


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, kind, norm, detail): the distinct entities of every
    document that has any."""
    def run(texts):
        out = []
        for t in texts:
            found = entities(t, detect(t))
            out.append([{"kind": k, "norm": n, "detail": d} for (k, n), d in sorted(found.items())])
        return [out]

    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    return (map_texts(keyed, ["text"], run, f"found array<struct<{_ENTITY.replace(' ', ':').replace(',:', ',')}>>")
            .select("doc_id", "text_key", F.explode("found").alias("e")).select("doc_id", "text_key", "e.*"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, detail, attempt, value): one surrogate per entity, distinct
    over the corpus and equal to no entity of it (whole names: with the surrogate
of the surname, distinct as surnames are). A name's gender is the one
    most of its documents tell (the first in the alphabet on ties)."""
    genders = found.groupBy("kind", "norm", "detail").agg(F.count("*").alias("n"))
    entities = shared_table(
        genders.groupBy("kind", "norm")
        .agg(F.max(F.struct(F.length("detail") > 0, F.col("n"), F.col("detail"))).alias("g"))
        .select("kind", "norm", F.col("g.detail").alias("detail")), "entities")

    def draw(rows: DataFrame, attempt: int) -> DataFrame:
        return map_texts(rows.select("kind", "norm", "detail"), ["kind", "norm", "detail"],
                         lambda k, n, d: [pa.array([surrogate(*x, attempt, key) for x in zip(k, n, d, strict=True)],
                                                   pa.string())],
                         "value string").withColumn("attempt", F.lit(attempt))

    def shown(value: str):
        """What a reader can compare: numbers without format and kind, others by kind."""
        bare = F.lower(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
        return F.when(F.col("kind").isin(*NUMBERS) & (bare != ""), bare) \
                .otherwise(F.concat_ws(":", "kind", value)).alias("shown")

    def clashes(rows: DataFrame, settled: DataFrame | None) -> DataFrame:
        """Entities of ``rows`` whose surrogate is taken."""
        rows = rows.select("kind", "norm", shown("value"))
        who = F.struct("kind", "norm")
        first = rows.groupBy("shown").agg(F.min(who).alias("first"), F.count("*").alias("n"))
        second = rows.join(first.where("n > 1"), "shown").where(who != F.col("first")).select("kind", "norm")
        real = rows.join(entities.select(shown("norm")), "shown", "left_semi")
        lost = second.unionByName(real.select("kind", "norm"))
        if settled is not None:
            old = rows.join(settled.select(shown("value")), "shown", "left_semi")
            lost = lost.unionByName(old.select("kind", "norm"))
        return lost.distinct()

    settled, todo = None, entities
    for attempt in range(MAX_ROUNDS):
        drawn = shared_table(draw(todo, attempt), "surrogates")
        lost = shared_table(clashes(drawn, settled), "clashes")
        good = drawn.join(lost, ["kind", "norm"], "left_anti")
        settled = good if settled is None else settled.unionByName(good.select(settled.columns))
        if lost.isEmpty():
            return settled.select("kind", "norm", "detail", "attempt", "value")
        todo = drawn.join(lost, ["kind", "norm"], "left_semi").select("kind", "norm", "detail")
    raise RuntimeError(f"surrogates still clash after {MAX_ROUNDS} draws")


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text",
                spans: str = "pii_spans") -> DataFrame:
    """``docs`` with surrogates in ``text`` and an added column ``spans``:
    (start, end, kind) of every replacement in the new text. Whoever knows
    ``key`` can recompute surrogates; an empty one is refused."""
    if not key:
        raise ValueError("replace_pii needs a secret key")
    return shielded(docs, [doc_id, text], lambda d: _replace(d, key.encode("utf-8"), doc_id, text, spans),
                    (spans,))


def _replace(docs: DataFrame, secret: bytes, doc_id: str, text: str, spans: str) -> DataFrame:
    found = shared_table(mentions(docs, doc_id, text), "mentions")
    settled = shared_table(assign(found, secret), "assigned")
    # exceptions: redrawn entities, and names whose document tells another gender
    odd = (found.alias("f").join(settled.alias("s"), ["kind", "norm"])
           .where("s.attempt > 0 OR s.detail <> f.detail")
           .groupBy(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key"))
           .agg(F.collect_list(F.struct("kind", "norm", F.col("s.detail").alias("detail"),
                                        F.col("s.attempt").alias("attempt"))).alias("_odd")))
    odd = shared_table(odd, "exceptions")
    rows, items = odd.agg(F.count("*"), F.coalesce(F.sum(F.size("_odd")), F.lit(0))).first()
    odd_type = f"array<struct<{_ENTITY.replace(' ', ':').replace(',:', ',')},attempt:int>>"
    if rows:
        cond = F.col(doc_id).eqNullSafe(F.col("_id")) & text_key(text).eqNullSafe(F.col("_key"))
        marked = docs.join(small_side(odd, 1, 64 * rows + 96 * items), cond, "left").drop("_id", "_key")
    else:
        marked = docs.withColumn("_odd", F.lit(None).cast(odd_type))
    columns = docs.columns
    memo: dict = {}

    def one(t, exceptions):
        hits = detect(t)
        if not hits:
            return t, []
        special = {(e["kind"], e["norm"]): (e["detail"], e["attempt"]) for e in exceptions or ()}
        first = entities(t, hits)

        def assigned(kind, norm):
            detail, attempt = special.get((kind, norm), (first[(kind, norm)], 0))
            entity = (kind, norm, detail, attempt)
            value = memo.get(entity)
            if value is None:
                if len(memo) > 100_000:
                    memo.clear()
                value = memo[entity] = surrogate(*entity, secret)
            return value

        out, places, at, size = [], [], 0, 0
        for a, b, kind, _ in hits:
            norm = normal_form(kind, t[a:b])
            if kind == "name":
                value = assigned("surname", surname_of(norm))
                if surname_of(norm) != norm:
                    value = full_name(assigned(kind, norm), value)
            else:
                value = assigned(kind, norm)
            new = render(kind, t[a:b], norm, value)
            out += [t[at:a], new]
            size += a - at
            places.append({"start": size, "end": size + len(new), "kind": kind})
            size += len(new)
            at = b
        return "".join([*out, t[at:]]), places

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(texts, exceptions):
        got = [one(t, e) for t, e in zip(texts, exceptions, strict=True)]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], span)]

    new = map_texts(marked, [text, "_odd"], run,
                    f"_text string, `{spans}` array<struct<start:int,end:int,kind:string>>")
    return new.select(*[F.col("_text").alias(c) if c == text else F.col(c) for c in columns], spans)
