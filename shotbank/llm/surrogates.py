"""Personal data and secrets are replaced by keyed surrogates of the same type and format.

A surrogate is a function of the key, the kind and the canonical form of an entity, so all mentions of an
entity, in any document and any notation, get the same one (coreference). It has the length, script and
character classes of the original: digits stay digits, check digits stay right, a name keeps its script
and the gender of its title. Two entities never share a surrogate and no surrogate is an entity of the
corpus: colliding ones are found over the whole corpus and drawn again, and after a few draws the free
values of the format are dealt out. Where a format has fewer free values than entities (such as one-letter
names, when most letters are names), it is widened (any letter of the script, any digit); where that is
full too, the entities left swap their forms, so a surrogate may there be another entity of the corpus,
but still is never shared and never one's own.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotbank.llm.common import fresh, in_batches, map_rows, written

KEY = b"replace this key in production"
#: Redrawn entities are shipped to the tasks up to this many, and joined by a shuffle beyond.
SHIP_ROWS = 100_000
#: After so many draws, what still collides is dealt the free values of its format.
MAX_DRAWS = 6
#: Values of a format that are looked at first, at most at a time, and by one row.
FIRST_WALK, MAX_WALK, STEP = 1024, 1 << 24, 64

# Titles, by the gender they tell
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof", "доктор"]
# Letters for surrogate names, by script (vowels, consonants, typical female end)
SCRIPTS = {
    "latin": ("aeiou", "bdfgklmnprstv", "a"),
    "cyrillic": ("аеиоу", "бвгдзклмнпрст", "а"),
    "greek": ("αεηιο", "βγδκλμνπρστφ", "α"),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
DIGITS = "0123456789"

_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_NAME_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
TITLE = re.compile(rf"\b({_TITLE})\.? +")
# Small words inside family names, and articles that only follow one of them
_PARTICLE = (r"(?:von und zu|von|vom|van|de|del|della|di|da|du|do|dos|bin|ibn|al|el|ter|ten|af|av|y)"
             r"(?: +(?:der|den|dem|het|la|las|los|le|les|zu))?")
#: A name's next word, after its particles. A title starts another name, but for Don, which is a first name too.
NEXT = re.compile(rf"(?:{_PARTICLE} +)?(?!(?:{'|'.join(t for t in _TITLE.split('|') if t != 'Don')})\b)({_NAME_WORD})")
INITIAL, AFTER_INITIAL, SPACES = re.compile(r"[^\W\d_]\."), re.compile(r"\.(?:-| *)"), re.compile(" +")
# Words that mostly open a sentence, so that after an initial they may not be part of the name
OPENERS = set("The This That He She It They We You In On At And But If When Der Die Das Er Sie Es El Ella Il Elle Он Она".split())
#: Kinds in the order in which they claim a piece of text.
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")),
    ("aws_key", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")),
    ("secret", re.compile(r"\b(?:token|password|passwd|pwd|secret|api[_-]?key|key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/.-]{8,}[A-Za-z0-9_+/=-])", re.I)),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])")),
    ("card", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)")),
]
# Lengths of IBANs, by country
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}
BLANK = "\uffff"
#: Without one of these no pattern matches.
_SIGNS = re.compile("[0-9@]|A[KS]IA")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def canonical(kind: str, raw: str) -> str:
    """What all notations of an entity have in common."""
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", raw)
    if kind == "phone":
        return re.sub(r"[^0-9]", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "email":
        return raw.lower()
    if kind.startswith("name"):
        return raw.lower()
    return raw


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities of a text: (start, end, kind), in order and without overlap."""
    taken: list[tuple[int, int, str]] = []
    left = text  # what is claimed is blanked, so that no later kind reaches into it

    def claim(spans: list[tuple[int, int, str]]) -> str:
        taken.extend(spans)
        parts, at = [], 0
        for a, b, _ in sorted(spans):
            parts += [left[at:a], BLANK * (b - a)]
            at = b
        return "".join([*parts, left[at:]])

    if _SIGNS.search(text):
        for kind, pattern in PATTERNS:
            spans = []
            if kind == "iban":
                spans = [(a, b, kind) for a, b in _ibans(left, pattern)]
            for m in pattern.finditer(left) if kind != "iban" else ():
                g = 1 if kind == "secret" else 0
                if kind == "secret" and not re.search("[0-9]", m[g]):
                    continue
                if kind == "card" and not luhn(canonical(kind, m[0])):
                    continue
                spans.append((*m.span(g), kind))
            if spans:
                left = claim(spans)
    names: dict[str, str] = {}
    spans, end = [], 0
    for m in TITLE.finditer(left):
        if m.start() < end:
            continue  # a word of the name before
        gender = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "n"
        words = name_words(left, m.end())
        for i, (a, b) in enumerate(words):
            kind = "name_family" if i == len(words) - 1 else f"name_{gender}"
            spans.append((a, b, kind))
            end = b
            # an opener after an initial is masked here, but isn't looked for elsewhere
            if not (i and words[i - 1][1] - words[i - 1][0] == 1 and left[a:b] in OPENERS):
                names.setdefault(left[a:b], kind)
    if spans:
        left = claim(spans)
    if names:  # other mentions of the same people without a title
        long = "|".join(map(re.escape, sorted((w for w in names if len(w) > 1), key=len, reverse=True)))
        short = "".join(map(re.escape, (w for w in names if len(w) == 1)))
        # a single letter is a mention only as an initial before a name: "I" and "A" are words
        either = [rf"(?:{long})\b"] * bool(long) + [rf"[{short}](?=\.(?:[ -]?[^\W\d_]\.)* ?(?:{long})\b)"] * bool(long and short)
        if either:
            for m in re.finditer(rf"\b(?:{'|'.join(either)})", left):
                taken.append((*m.span(), names[m[0]]))
    return sorted(taken)


def name_words(text: str, at: int) -> list[tuple[int, int]]:
    """Where the words of the name are that begins at ``at``: capitalised words and initials, however many.
    Particles between them are passed over, a possessive or a title ends the name."""
    out = []
    while m := NEXT.match(text, at):
        w = m[1]
        if not (w[0].isupper() or any(x[0].isupper() for x in re.split("['’-]", w)[1:])):  # d'Artagnan, al-Masri
            break
        bare = re.sub("['’]s$", "", w)  # a possessive is not part of the name
        out.append((m.start(1), m.start(1) + len(bare)))
        if bare != w:
            break
        at = m.end()
        step = (AFTER_INITIAL if INITIAL.match(text, m.start(1)) else SPACES).match(text, at)
        if not step:
            break
        at = step.end()
    return out


def _ibans(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """IBANs of a text. What follows may look like one more group, so the whole words of a match are tried from
    all of them down to one, those of the country's length first; the search goes on after the IBAN's end, or
    within a match that holds none at its start."""
    out, at = [], 0
    while m := pattern.search(text, at):
        ends = [i for i in range(m.end(), m.start() + 14, -1) if i == len(text) or not re.match(r"\w", text[i])]
        ends = [i for i in ends if text[i - 1] != " "]
        length = IBAN_LENGTHS.get(m[0][:2])
        ends.sort(key=lambda i: len(text[m.start():i].replace(" ", "")) != length)
        end = next((i for i in ends if _iban_ok(text[m.start():i].replace(" ", ""))), None)
        if end:
            out.append((m.start(), end))
        at = end or m.start() + 1
    return out


def _iban_ok(s: str) -> bool:
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Draw:
    """Numbers drawn from the key and the entity."""

    def __init__(self, key: bytes, kind: str, canon: str, draw: int):
        self.seed = (key, f"{kind}\0{canon}\0{draw}".encode("utf-8", "replace"))
        self.pool, self.n = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.seed[0], self.seed[1] + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32

    def of(self, letters: str) -> str:
        return letters[self.below(len(letters))]

    def like(self, s: str) -> str:
        """Each letter and digit by another of its kind; hexadecimal stays so."""
        hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None and not s.isdigit()
        low, up = ("abcdef", "ABCDEF") if hexa else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return "".join(self.of("0123456789") if c.isdigit() else self.of(low) if c.islower()
                       else self.of(up) if c.isupper() else c for c in s)


def surrogate(key: bytes, kind: str, canon: str, draw: int = 0) -> str:
    """The canonical form of the surrogate, as long as ``canon``."""
    d = _Draw(key, kind, canon, draw)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        # a domain keeps its surrogate whoever writes from it; the last label stays
        dom = _Draw(key, "domain", domain, 0)
        return d.like(local) + "@" + ".".join([*(dom.like(x) for x in labels[:-1]), labels[-1]])
    if kind == "aws_key":
        return canon[:4] + "".join(d.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in canon[4:])
    if kind == "ip":
        out = []
        octets = canon.split(".")
        keep = 2 if canon.startswith("192.168.") else 1 if octets[0] in ("10", "127") else 0
        for i, o in enumerate(octets):
            low, high = {1: (0 if i else 1, 9), 2: (10, 99), 3: (100, 255 if i else 223)}[len(o)]
            out.append(o if i < keep else str(low + d.below(high - low + 1)))
        return ".".join(out)
    if kind == "card":
        body = canon[0] + "".join(d.of("0123456789") for _ in canon[1:-1])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = d.like(canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "phone":
        # the leading digit and the reserved exchange 555 tell the numbering plan, not the person
        keep = 1
        s = canon[:keep] + "".join(d.of("0123456789") for _ in canon[keep:])
        return s[:-7] + "555" + s[-4:] if len(s) >= 10 and canon[-7:-4] == "555" else s
    if kind == "ssn":
        return "".join(d.of("0123456789") for _ in canon)
    if kind.startswith("name"):
        return _name(d, canon, kind)
    return d.like(canon)


def _script(code: int) -> str:
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin"


def _name(d: _Draw, canon: str, kind: str) -> str:
    out = []
    for part in re.split(r"(['’-])", canon):
        if part in "'’-":
            out.append(part)
            continue
        code = ord(part[0])
        vowels, others, female = SCRIPTS[_script(code)]
        flip = d.below(2)
        s = [d.of(vowels if (i + flip) % 2 else others) for i in range(len(part))]
        if kind in ("name_f", "name_m") and len(s) > 1:
            s[-1] = female if kind == "name_f" else d.of(others)
        out.append("".join(s))
    return "".join(out)


def slots(key: bytes, kind: str, canon: str, wide: bool) -> list:
    """The format of an entity: the values that each place of its surrogates may take. All that is drawn
    is in the wide format; wide formats of a kind are equal or have no value in common."""
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        return _like(local, wide) + list("@" + surrogate(key, kind, canon).rpartition("@")[2])
    if kind == "aws_key":
        return [*canon[:4], *["ABCDEFGHIJKLMNOPQRSTUVWXYZ" + (DIGITS if wide else "234567")] * (len(canon) - 4)]
    if kind == "ip":
        out, octets = [], canon.split(".")
        keep = 0 if wide else 2 if canon.startswith("192.168.") else 1 if octets[0] in ("10", "127") else 0
        for i, o in enumerate(octets):
            low, high = {1: (0 if i or wide else 1, 9), 2: (10, 99), 3: (100, 255 if i or wide else 223)}[len(o)]
            out += [".", [o] if i < keep else [str(x) for x in range(low, high + 1)]]
        return out[1:]
    if kind == "card":  # the check digit follows
        return [DIGITS if wide else canon[0], *[DIGITS] * (len(canon) - 2)]
    if kind == "iban":  # so do the check digits
        return [*canon[:2], *_like(canon[4:], wide)]
    if kind == "phone":
        out = [DIGITS if wide else canon[0], *[DIGITS] * (len(canon) - 1)]
        if not wide and len(out) >= 10 and canon[-7:-4] == "555":
            out[-7:-4] = "555"
        return out
    if kind == "ssn":
        return [DIGITS] * len(canon)
    if kind.startswith("name"):
        out = []
        for part in re.split(r"(['’-])", canon):
            if part in "'’-":
                out += part
                continue
            script = _script(ord(part[0]))
            out += [ALPHABETS[script]] * len(part)
            if not wide and kind in ("name_f", "name_m") and len(part) > 1:
                out[-1] = SCRIPTS[script][2 if kind == "name_f" else 1]
        return out
    return _like(canon, wide)


def _like(s: str, wide: bool) -> list[str]:
    hexa = not wide and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None and not s.isdigit()
    low = "abcdef" if hexa else ALPHABETS["latin"]
    return [DIGITS if c.isdigit() else low if c.islower() else low.upper() if c.isupper() else c for c in s]


def _checked(kind: str, s: str) -> str:
    """A value of a format with its check digits."""
    if kind == "card":
        return next(s + c for c in DIGITS if luhn(s + c))
    if kind == "iban":
        return f"{s[:2]}{98 - int(''.join(str(int(c, 36)) for c in s[2:] + s[:2] + '00')) % 97:02d}{s[2:]}"
    return s


def walk(key: bytes, kind: str, fmt: str, at: int, n: int) -> list[str]:
    """The values of a format (:func:`slots` as JSON) from place ``at`` on, in an order given by the key; no value comes twice."""
    places = json.loads(fmt)
    size = math.prod(map(len, places))
    h = hmac.new(key, f"walk\0{kind}\0{fmt}".encode("utf-8", "replace"), hashlib.sha512).digest()
    step, start = int.from_bytes(h[:32], "big") % size, int.from_bytes(h[32:], "big") % size
    while math.gcd(step, size) != 1:
        step += 1
    out = []
    for i in range(at, min(size, at + n)):
        v, parts = (start + i * step) % size, []
        for p in places:
            v, x = divmod(v, len(p))
            parts.append(p[x])
        out.append(_checked(kind, "".join(parts)))
    return out


def dress(kind: str, raw: str, made: str) -> str:
    """The surrogate in the notation of one mention (case, spaces, punctuation)."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(made)
        return "".join(next(chars) if c.isalnum() else c for c in raw)
    return "".join(m.upper() if r.isupper() else m for r, m in zip(raw, made))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon): the distinct entities of all texts, combined before the shuffle."""

    def run(cols: dict) -> dict:
        seen = {(k, canonical(k, t[a:b])) for t in cols["text"].to_pylist() if t for a, b, k in find(t)}
        return {"kind": [k for k, _ in seen], "canon": [c for _, c in seen]}

    return map_rows(docs.select(F.col(text_col).cast("string").alias("text")), "kind string, canon string", run).distinct()


def redrawn(found: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """(kind, canon, made): the entities whose first surrogate collides, with the one that does not;
    None if there is none. ``found`` is what :func:`entities` returns, written.

    Of entities with equal surrogates the first (in order) keeps it; a surrogate that is itself an
    entity of the corpus is never kept. Each round is two joins over distinct entities only. What
    collides after ``MAX_DRAWS`` rounds is settled by :func:`_dealt`.
    """
    def made(rows: DataFrame) -> DataFrame:
        def run(cols: dict) -> dict:
            return {**{c: cols[c] for c in ("kind", "canon", "draw")}, "made": [
                surrogate(key, k, c, n) for k, c, n in zip(*(cols[x].to_pylist() for x in ("kind", "canon", "draw")))]}

        return map_rows(rows.select("kind", "canon", "draw"), "kind string, canon string, draw int, made string", run)

    assigned = written(made(found.select("kind", "canon", F.lit(0).alias("draw"))), "surrogates")
    for n in range(MAX_DRAWS + 1):
        # earlier draws and smaller names go first, so who has settled stays
        first = assigned.groupBy("kind", "made").agg(F.min(F.struct("draw", "canon")).alias("first"))
        real = found.select(F.col("kind").alias("rk"), F.col("canon").alias("rc"))
        judged = (assigned.join(first, ["kind", "made"])
                  .join(real, (F.col("kind") == F.col("rk")) & (F.col("made") == F.col("rc")), "left")
                  .withColumn("again", F.col("rc").isNotNull() | (F.col("first.canon") != F.col("canon"))))
        judged = written(judged.select("kind", "canon", "draw", "made", "again"), "surrogates")
        again, settled = judged.where("again"), judged.where("not again").select("kind", "canon", "draw", "made")
        if n == MAX_DRAWS or again.isEmpty():
            break
        assigned = written(settled.union(made(again.withColumn("draw", (F.col("draw") + 1).cast("int")))), "surrogates")
    if not again.isEmpty():
        settled = _dealt(found, settled, again.select("kind", "canon"), key)
    late = settled.where("draw > 0").select("kind", "canon", "made")
    return None if late.isEmpty() else late


def _formats(rows: DataFrame, key: bytes, wide: bool) -> DataFrame:
    """(kind, canon, fmt, room, place): the format of each entity, how many values it has, and a keyed hash of the entity."""

    def run(cols: dict) -> dict:
        out = {"fmt": [], "room": [], "place": []}
        for k, c in zip(cols["kind"].to_pylist(), cols["canon"].to_pylist()):
            f = slots(key, k, c, wide)
            out["fmt"].append(json.dumps(f))
            out["room"].append(min(math.prod(map(len, f)), 1 << 62))
            out["place"].append(_Draw(key, "place", f"{k}\0{c}", 0).below(1 << 31))
        return {"kind": cols["kind"], "canon": cols["canon"], **out}

    return map_rows(rows.select("kind", "canon"), "kind string, canon string, fmt string, room long, place long", run)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in (kind, fmt), from 0 on. Ranges are sorted apart and counted, so a format is no task's alone."""
    group = ["kind", "fmt"]
    rows = written(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), "ranked")
    parts = rows.groupBy(*group, "task").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(*group, "task", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift")), "ranges")
    return rows.join(parts, [*group, "task"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def _dealt(found: DataFrame, settled: DataFrame, left: DataFrame, key: bytes) -> DataFrame:
    """``settled`` (kind, canon, draw, made) with all of ``left`` (kind, canon) added: entities are ranked in
    their format, its values are walked in a keyed order, and the entity of each rank gets the free value of that rank."""
    cols, late = ["kind", "canon", "draw", "made"], F.lit(MAX_DRAWS + 1).alias("draw")
    for wide in (False, True):
        rows, at, n = written(_formats(left, key, wide), "left"), 0, FIRST_WALK
        while not rows.where(F.col("room") > at).isEmpty():
            end = F.least("room", F.lit(at + n)) - 1
            steps = (rows.where(F.col("room") > at).groupBy("kind", "fmt").agg(F.max("room").alias("room"))
                     .select("kind", "fmt", F.explode(F.sequence(F.lit(at).cast("long"), end, F.lit(STEP).cast("long"))).alias("lo")))

            def run(cols: dict, top: int = at + n) -> dict:
                out = {"kind": [], "fmt": [], "made": [], "place": []}
                for k, f, lo in zip(*(cols[x].to_pylist() for x in ("kind", "fmt", "lo"))):
                    values = walk(key, k, f, lo, min(STEP, top - lo))
                    out["kind"] += [k] * len(values)
                    out["fmt"] += [f] * len(values)
                    out["made"] += values
                    out["place"] += range(lo, lo + len(values))
                return out

            values = map_rows(steps.repartition("kind", "fmt", "lo"), "kind string, fmt string, made string, place long", run, 1 << 18)
            taken = settled.select("kind", "made").union(found.select("kind", "canon"))
            free = (values.join(taken, ["kind", "made"], "left_anti")
                    .groupBy("kind", "made").agg(F.min(F.struct("fmt", "place")).alias("f")).select("kind", "made", "f.fmt", "f.place"))
            got = _ranked(rows, ["place", "canon"]).drop("place").join(
                _ranked(free, ["place"]).select("kind", "fmt", "rank", "made"), ["kind", "fmt", "rank"])
            got = written(got.select("kind", "canon", late, "made"), "dealt")
            settled = written(settled.union(got), "surrogates")
            rows = written(rows.join(got, ["kind", "canon"], "left_anti").select(*rows.columns), "left")
            at, n = at + n, min(8 * n, MAX_WALK)
        left = rows
    if left.isEmpty():
        return settled
    # the wide format is full: those left take each other's form
    size = written(left.groupBy("kind", "fmt").agg(F.count("*").alias("n")), "full")
    rows = written(_ranked(left, ["place", "canon"]).join(size, ["kind", "fmt"]), "left")
    after = rows.select("kind", "fmt", F.pmod(F.col("rank") - 1, F.col("n")).alias("rank"), F.col("canon").alias("made"))
    new = rows.where("n > 1").join(after, ["kind", "fmt", "rank"]).select("kind", "canon", late, "made")
    lone = written(rows.where("n = 1").select("kind", "fmt", F.col("canon").alias("one")), "lone")
    if not lone.isEmpty():
        # one that is left alone takes the surrogate of a settled one, which takes its form
        mates = (_formats(settled, key, True).join(lone, ["kind", "fmt"]).join(settled, ["kind", "canon"])
                 .groupBy("kind", "fmt").agg(F.min(F.struct("canon", "made")).alias("mate")))
        pairs = written(lone.join(mates, ["kind", "fmt"], "left"), "mates")

        def first(cols: dict) -> dict:  # without such a one no value of the format is a surrogate yet
            made = [next(v for v in walk(key, k, f, 0, 2) if v != c) for k, f, c in zip(*(cols[x].to_pylist() for x in ("kind", "fmt", "one")))]
            return {"kind": cols["kind"], "canon": cols["one"], "draw": [MAX_DRAWS + 1] * len(made), "made": made}

        moved = pairs.where("mate is not null").select("kind", F.col("mate.canon").alias("canon"), late, F.col("one").alias("made"))
        new = (new.union(moved).union(pairs.where("mate is not null").select("kind", F.col("one").alias("canon"), late, F.col("mate.made").alias("made")))
               .union(map_rows(pairs.where("mate is null").select("kind", "fmt", "one"), "kind string, canon string, draw int, made string", first)))
        settled = settled.join(moved.select("kind", "canon"), ["kind", "canon"], "left_anti").select(*cols)
    return written(settled.union(new.select(*cols)), "surrogates")


def _draws(docs: DataFrame, text_col: str, key: bytes) -> tuple[DataFrame, str | None, dict]:
    """(docs, column, made): the redrawn entities to ship, or, if they are too many, a column of each
    row's own; a row is known by the hash of its text."""
    late = redrawn(written(entities(docs, text_col), "entities"), key)
    if late is None:
        return docs, None, {}
    if late.count() <= SHIP_ROWS:
        return docs, None, {(r["kind"], r["canon"]): r["made"] for r in late.collect()}

    def run(cols: dict) -> dict:
        out = {"t": [], "k": [], "c": []}
        for th, t in zip(cols["th"].to_pylist(), cols["text"].to_pylist()):
            for k, c in {(k, canonical(k, t[a:b])) for a, b, k in find(t)} if t else ():
                out["t"].append(th)
                out["k"].append(k)
                out["c"].append(c)
        return out

    th, own = F.xxhash64(F.col(text_col).cast("string")), fresh(docs, "draws")
    found = (map_rows(docs.select(th.alias("th"), F.col(text_col).cast("string").alias("text")), "t long, k string, c string", run)
             .distinct().join(late, (F.col("k") == F.col("kind")) & (F.col("c") == F.col("canon"))))
    key_col = fresh(docs, "text_hash")
    per_text = found.groupBy(F.col("t").alias(key_col)).agg(F.collect_list(F.struct("kind", "canon", "made")).alias(own))
    return docs.withColumn(key_col, th).join(per_text, key_col, "left").drop(key_col), own, {}


def _rewriter(key: bytes, shared):
    def run(text: str | None, mine: list | None) -> tuple[str | None, list]:
        known = shared.value if mine is None else {(x["kind"], x["canon"]): x["made"] for x in mine}
        new, at, ents = [], 0, []
        for a, b, kind in find(text) if text else ():
            canon = canonical(kind, text[a:b])
            s = dress(kind, text[a:b], known.get((kind, canon)) or surrogate(key, kind, canon))
            new += [text[at:a], s]
            at = b
            ents.append({"kind": kind, "start": a, "end": b, "surrogate": s})
        return ("".join([*new, text[at:]]) if ents else text), ents

    return run


def replace(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, entities) of every row: the text with surrogates, and where they are
    (character offsets, the same in both texts).

    Null texts stay null, empty ones empty, with no entities; texts without entities are unchanged.
    Repeated rows are treated one by one and alike. Other columns are ignored. Texts aren't shuffled
    unless so many entities collide that their draws can't be shipped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, own, draws = _draws(rows, "text", key)
    rewrite_one = _rewriter(key, docs.sparkSession.sparkContext.broadcast(draws))

    def run(cols: dict) -> dict:
        texts = cols["text"].to_pylist()
        done = [rewrite_one(t, m) for t, m in zip(texts, cols[own].to_pylist() if own else [None] * len(texts))]
        return {"doc_id": cols["doc_id"], "text": [t for t, _ in done], "n_entities": [len(e) for _, e in done],
                "entities": [e for _, e in done]}

    return map_rows(rows, "doc_id long, text string, n_entities int, "
                          "entities array<struct<kind: string, start: int, end: int, surrogate: string>>", run)


def rewrite(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with surrogates in ``text_col`` (see :func:`replace`)."""
    rows, own, draws = _draws(docs, text_col, key)
    rewrite_one = _rewriter(key, docs.sparkSession.sparkContext.broadcast(draws))

    names, schema = rows.columns, docs.schema

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(names)}
            texts = cols[text_col].to_pylist()
            mine = cols[own].to_pylist() if own else [None] * len(texts)
            cols[text_col] = pa.array([rewrite_one(t, m)[0] for t, m in zip(texts, mine)], pa.string())
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=[f.name for f in schema])

    return in_batches(rows, run, schema)
