"""PII replacement by keyed, type-consistent surrogates.

Entities are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, bank account numbers (IBAN),
payment card numbers, and personal names (after a title, a known given name before a capitalised word,
or, in Han script, before an honorific). Further mentions of a found name's words, alone and capitalised,
are replaced in the same document. The surrogate of an entity is a keyed permutation of its canonical form:
a step along one cycle through exactly the forms of the same type and format, ordered by a Feistel network
that is walked until it ends inside them. A cycle has no fixed points, so no entity stands for itself. One
entity has one surrogate wherever it stands, in any document and on any executor, and two never share one,
without a table of entities. What is kept, by type:

    email    lengths of the parts, letters, digits and marks in their places, the top-level domain
    phone    country code (by the table of codes, however it is spaced), length, punctuation; a first
             digit of 2 or more stays so
    ipv4     private, local, public or other
    ipv6     the first group, where zeros are left out, letters and digits
    iban     country, letters and digits in their places; its check digits are those of the new number
    card     length, grouping, first digit, and whether the Luhn check digit is right
    name     title, gender, script, capitals; known given names become others of their gender and
             script wherever they stand, other words get letters of their script, vowels for vowels,
             accented letters for accented ones, and never become a known given name

Case and punctuation follow the original (EVA for EVA), but don't tell entities apart. A form in which
nothing can be moved gets a keyed code of ten hexadecimal digits. As a guard, in every document the
surrogates are held against each other; if two entities came to one, the later by order would be permuted
again.

Defined results: null and empty texts stay as they are and have no entities. Rows with a null or
repeated doc_id are replaced like others, equal rows equally. n_chars, where there is one, is the
new length. An empty table gives an empty result. Entities that overlap: the one that begins first
counts, the longer of two that begin together. A very long text is read whole. A column named pii is
replaced by the result's.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common

ADDED = "text string, pii array<struct<kind: string, surrogate: string>>"

GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Beatriz Carla Carmen Charlotte Clara Elena Elisabeth Emma Eva Fatima Hannah Helen Ines Isabel Jane Julia Karen Laura Linda Lucia Maria Martha Mary Nadia Olivia Patricia Petra Rosa Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria Yvonne".split(),
    ("m", "latin"): "Adam Alan Albert Anton Bernard Carlos Charles Daniel David Diego Edward Eric Felix Francisco Frank George Hans Henry Hugo Ivan Jack James Javier John Jorge Karl Louis Luis Marco Martin Michael Miguel Oliver Oscar Paul Pedro Peter Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Ольга Елена Мария Наталья Ирина Светлана Татьяна Екатерина Юлия Дарья Вера Надежда Любовь София".split(),
    ("m", "cyrillic"): "Александр Сергей Дмитрий Алексей Андрей Иван Михаил Николай Павел Пётр Юрий Олег Владимир Виктор Борис".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αναστασία Ειρήνη Δήμητρα Χριστίνα Αγγελική".split(),
    ("m", "greek"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Μιχαήλ".split(),
}
TITLES = {
    "m": "Mr Herr Señor Sr Monsieur Sir Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Madam Госпожа Κυρία".split(),
    "n": "Dr Prof Professor Doctor Доктор".split(),
}
VOWELS = {"latin": ("aeiouy", "bcdfghjklmnpqrstvwxz"), "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
#: Letters beyond those, as sets whose members stand for each other; each has a capital of one character, or no case.
MORE = {
    "latin": ("àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñðþ", "āăąēėęěīįōőūůűųǎǐǒǔ", "ćčďđğģķĺľłńņňŕřśşșšţťțźżž"),
    "cyrillic": ("ёіїєў", "йґђћџљњјқңғһ", "ъь"),
    "greek": ("άέήίόύώϊϋ",),
}


def letters(first: int, last: int) -> str:
    return "".join(chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)) == "Lo")


SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
GIVEN_HAN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂文辉红玉建国华志海波宁晨雪梅琳佳欣怡婷"
HAN = ["".join(dict.fromkeys(SURNAMES)), "".join(c for c in dict.fromkeys(GIVEN_HAN) if c not in SURNAMES)]
#: Scripts without case, for addresses and names: Hebrew, Arabic, Devanagari, Thai, kana, Hangul, Han.
CASELESS = [letters(*x) for x in ((0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3))]
CASELESS += [*HAN, "".join(c for c in letters(0x4E00, 0x9FFF) if c not in "".join(HAN))]
LETTERS = {k: [*VOWELS[k], *MORE[k]] for k in VOWELS}
HONORIFICS = "先生|女士|小姐|太太"
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
CAPITAL = "[" + "".join(c for c in map(chr, (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))) if unicodedata.category(c) == "Lu") + "]"
WORD = rf"{CAPITAL}[^\W\d_]*(?:['’-][^\W\d_]+)?"
ENTITY = re.compile(
    rf"""
    (?P<email>(?<![\w.+-])[^\W_][\w.+-]*+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{{2,}})
  | (?=[\d+(])(?:(?P<phone>(?<!\w)\+\d{{1,3}}[^\w\n]{{1,6}}(?:\(0\)[ ]?)?\d{{2,4}}[^\w\n]{{1,6}}\d{{3,4}}[ .-]\d{{2,4}}(?:[ .-]?\d{{2}})?(?!\d)|(?<![\w.])\(\d{{3}}\)[ .-]?\d{{3}}[.-]\d{{4}}(?!\d)|(?<![\w.+-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-])|(?<!\w)\+\d{{8,15}}(?!\d))
  | (?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
  | (?P<card>(?<![\w.-])(?:\d[ -]?){{12,18}}\d(?![\w-])))
  | (?P<ipv6>(?<![\w:.])[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![\w:]))
  | (?=[A-Z]{{2}}\d\d)(?P<iban>(?<!\w)[A-Z]{{2}}\d\d(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
  | (?={CAPITAL})(?<!\w)(?:(?P<title>\b(?:{"|".join(t for v in TITLES.values() for t in v)})\b\.?)[ ](?P<named>{WORD}(?:[ ]{CAPITAL}[^\W\d_]+)?)
  | (?P<person>\b(?:{"|".join(sorted({n for v in GIVEN.values() for n in v}, key=len, reverse=True))})[ ]{CAPITAL}[^\W\d_]+))
  | (?P<han>[{SURNAMES}][\u4e00-\u9fff]{{0,2}}?(?={HONORIFICS}))
    """,
    re.VERBOSE,
)
#: Texts without any of these have no entity. Arrow's \b knows ASCII only, so names stand without bounds.
HINT = rf"@|\d|{HONORIFICS}|(?:" + "|".join(sorted({x for v in TITLES.values() for x in v} | {n for v in GIVEN.values() for n in v})) + ")[. ]"


#: Another in every process: without a key of one's own, surrogates are the same within one run only.
RUN_KEY = secrets.token_bytes(32)


@dataclass(frozen=True)
class PiiParams:
    key: bytes = RUN_KEY


def feistel(n: int, half: int, size: int, key: bytes, label: str, back: bool = False) -> int:
    """Eight Feistel rounds over numbers of two halves, or their inverse."""
    mask = (1 << half) - 1
    a, b = n >> half, n & mask
    for r in reversed(range(8)) if back else range(8):
        f = hashlib.blake2b(f"{label}|{size}|{r}|{a if back else b}".encode(), key=key[:64], digest_size=(half + 7) // 8 + 4).digest()
        f = int.from_bytes(f, "big") & mask
        a, b = (b ^ f, a) if back else (b, a ^ f)
    return a << half | b


def permuted(n: int, size: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network over the next even number of bits, walked back into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    while True:
        n = feistel(n, half, size, key, label, back)
        if n < size:
            return n


def stepped(n: int, size: int, key: bytes, label: str) -> int:
    """The next of range(size) on a keyed cycle through all of it: a permutation in which nothing stays (but in a range of one)."""
    return permuted((permuted(n, size, key, label, back=True) + 1) % size, size, key, label)


def lettered(text: str, alphabets: list[str], key: bytes, label: str) -> str:
    """text with each character moved inside the alphabet that holds it, all places together; others stay."""
    where = [next((a for a in alphabets if ch in a), None) for ch in text]
    number = 0
    size = 1
    for ch, a in zip(text, where):
        if a:
            number, size = number * len(a) + a.index(ch), size * len(a)
    if size == 1:
        return text
    shape = "".join("." if a is None else chr(97 + alphabets.index(a)) for a in where)
    number = stepped(number, size, key, f"{label}|{shape}|{''.join(c for c, a in zip(text, where) if a is None)}")
    out = []
    for ch, a in zip(reversed(text), reversed(where)):
        if a:
            number, k = divmod(number, len(a))
            out.append(a[k])
        else:
            out.append(ch)
    return "".join(reversed(out))


def walked(value: str, step, inside) -> str:
    """step applied until the result is inside exactly as the value is; a step along one cycle stays one on those values."""
    same, out = inside(value), step(value)
    while inside(out) != same:
        out = step(out)
    return out


def network(n: str) -> str:
    a, b = int(n) >> 24, int(n) >> 16 & 255
    if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
        return "private"
    return "local" if a in (0, 127) else "public" if a < 224 else "other"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def address(text: str) -> bool:
    """An IPv6 address that names three groups at least, one with a digit: not a time, nor names joined by colons."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) >= 3 and any(c.isdigit() for c in text)


def script_of(word: str) -> str | None:
    low = word.lower()
    return next((s for s, sets in LETTERS.items() if any(c in x for c in low for x in sets)), None)


def coded(kind: str, canonical: str, key: bytes) -> str:
    """For forms in which nothing can be moved."""
    return hashlib.blake2b(f"{kind}|{canonical}".encode(), key=key[:64], digest_size=5).hexdigest()


@lru_cache(maxsize=200_000)
def surrogate(kind: str, canonical: str, key: bytes, tweak: int = 0) -> str:
    """The canonical form that stands for another; a bijection on the forms of a kind and format."""
    new = moved(kind, canonical, key, tweak)
    return coded(kind, canonical, key) if new == canonical else new


def moved(kind: str, canonical: str, key: bytes, tweak: int) -> str:
    label = f"{kind}|{tweak}"
    digits, small = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    if kind == "email":
        local, _, domain = canonical.partition("@")
        name, _, top = domain.rpartition(".")
        sets = [small, digits, *["".join(LETTERS[k][2:]) for k in LETTERS], *["".join(LETTERS[k][:2]) for k in ("cyrillic", "greek")], *CASELESS]
        return lettered(local, sets, key, label + "|local") + "@" + lettered(name, sets, key, label + "|domain") + "." + top
    if kind == "phone":
        country, _, number = canonical.partition("|")
        return f"{country}|{walked(number, lambda x: lettered(x, [digits], key, f'{label}|{country}'), lambda x: x[:1] >= '2')}"
    if kind == "ipv4":
        n = sum(int(o) << 8 * (3 - k) for k, o in enumerate(canonical.split(".")))
        n = int(walked(str(n), lambda x: str(stepped(int(x), 1 << 32, key, label)), network))
        return ".".join(str(n >> 8 * (3 - k) & 255) for k in range(4))
    if kind == "ipv6":
        first, _, rest = canonical.partition(":")
        return first + ":" + lettered(rest, ["abcdef", "123456789"], key, f"{label}|{first}")
    if kind == "iban":
        body = canonical[:2] + "00" + lettered(canonical[4:], [small.upper(), digits], key, label + canonical[:2])
        return body[:2] + f"{98 - mod97(body):02d}" + body[4:]
    if kind == "card":
        if luhn(canonical):
            body = canonical[0] + lettered(canonical[1:-1], [digits], key, label + canonical[0])
            return body + next(d for d in digits if luhn(body + d))
        return canonical[0] + walked(canonical[1:], lambda x: lettered(x, [digits], key, label + canonical[0]), lambda x: luhn(canonical[0] + x))
    if kind.startswith("given"):
        _, gender, script = kind.split("|")
        pool = [n.lower() for n in GIVEN[gender, script]]
        return pool[stepped(pool.index(canonical), len(pool), key, label)]
    script = script_of(canonical)
    sets = LETTERS[script] if script else CASELESS
    if canonical in GENDER:  # not reached for words of a text: these are given names, wherever they stand
        return lettered(canonical, sets, key, f"{label}|{script}")
    return walked(canonical, lambda x: lettered(x, sets, key, f"{label}|{script}"), lambda x: x in GENDER)


GENDER = {n.lower(): k for k, v in GIVEN.items() for n in v}


def cased(new: str, old: str) -> str:
    """new with the capitals of old."""
    letters = [c for c in old if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return new.upper()
    if len(new) == len(old):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old))
    return "".join(w.capitalize() if k % 2 == 0 else w for k, w in enumerate(re.split(r"([-’'])", new))) if old[:1].isupper() else new


def refilled(form: str, digits: str) -> str:
    """form with its letters and digits replaced in order, but for a trunk zero in brackets."""
    it = iter(digits)
    return "".join(x if x == "(0)" else "".join(next(it) if c.isalnum() else c for c in x) for x in re.split(r"(\(0\))", form))


def canonical_of(kind: str, raw: str) -> str:
    if kind == "email":
        return raw.lower()
    if kind == "phone":
        digits = re.sub(r"\D", "", raw.replace("(0)", ""))
        if not raw.startswith("+"):
            return f"1|{digits}"
        code = next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])
        return f"{code}|{digits[len(code):]}"
    if kind == "card":
        return re.sub(r"\D", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    return ".".join(str(int(o)) for o in raw.split(".")) if kind == "ipv4" else raw.lower()


class Replacer:
    """One document's entities and their surrogates, with the collision check."""

    def __init__(self, key: bytes):
        self.key, self.of, self.taken = key, {}, {}

    def get(self, kind: str, canonical: str) -> str:
        if (kind, canonical) not in self.of:
            tweak = 0
            while True:
                new = surrogate(kind, canonical, self.key, tweak)
                owner = self.taken.get((kind, new))
                if owner in (None, canonical) or tweak == 16:
                    break
                tweak += 1
            self.of[kind, canonical] = new
            self.taken[kind, new] = canonical
        return self.of[kind, canonical]


def name_kind(word: str) -> str:
    """A known given name is one wherever it stands; others are names of no gender."""
    known = GENDER.get(word.lower())
    return f"given|{known[0]}|{known[1]}" if known else "name"


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, as written, start, end) in order."""
    found = []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup != "named" else "title"
        if kind in ("title", "person"):
            group = "named" if kind == "title" else kind
            start = m.start(group)
            for word in m[group].split(" "):
                found.append((name_kind(word), word, start, start + len(word)))
                start += len(word) + 1
        elif kind == "iban" and mod97(m[0].replace(" ", "")) != 1 or kind == "ipv6" and not address(m[0]):
            continue
        elif kind == "han":
            found.append(("name", m[0], m.start(), m.end()))
        else:
            found.append((kind, m[0], m.start(), m.end()))
    return found


def mentions(text: str, found: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """Where the words of found names stand alone: as written, with a capital, or in capitals."""
    names = {raw for kind, raw, *_ in found if (kind == "name" or kind.startswith("given")) and len(raw) > 1}
    if not names:
        return []
    forms = {f for n in names for f in (n, n.upper(), "-".join(x.capitalize() for x in n.split("-"))) if f[:1].isupper() or not f.isascii() and f.lower() == f.upper()}
    plain, han = ([f for f in sorted(forms, key=lambda f: (-len(f), f)) if (f.lower() == f.upper()) == x] for x in (False, True))
    parts = ([rf"(?<!\w)(?:{'|'.join(map(re.escape, plain))})(?!\w)"] if plain else []) + ([f"(?:{'|'.join(map(re.escape, han))})"] if han else [])
    taken, k, out = found, 0, []
    for m in re.finditer("|".join(parts), text):
        while k < len(taken) and taken[k][3] <= m.start():
            k += 1
        if k == len(taken) or taken[k][2] >= m.end():
            out.append((name_kind(m[0]), m[0], m.start(), m.end()))
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[dict]]:
    found = entities(text)
    if not found:
        return text, []
    found = sorted([*found, *mentions(text, found)], key=lambda f: f[2])
    originals = {(k, canonical_of(k, raw)) for k, raw, *_ in found}
    box, out, at, listed = Replacer(key), [], 0, []
    # in sorted order, so that the check doesn't depend on where they stand
    for k, c in sorted(originals):
        box.get(k, c)
    for kind, raw, start, end in found:
        canonical = canonical_of(kind, raw)
        new = box.of[kind, canonical]
        if new == coded(kind, canonical, key):
            pass
        elif kind == "phone":
            country, _, number = new.partition("|")
            new = refilled(raw, (country if raw.startswith("+") else "") + number)
        elif kind in ("card", "iban"):
            new = refilled(raw, new)
        elif kind != "ipv4":
            new = cased(new, raw)
        out += [text[at:start], new]
        at = end
        listed.append({"kind": kind.split("|")[0], "surrogate": new})
    return "".join([*out, text[at:]]), listed


def replace(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """docs with surrogates in text, and pii: kind and surrogate of each entity in order."""

    def make():
        def compute(batch):
            text = batch.column(batch.schema.get_field_index("text"))
            look = pc.fill_null(pc.match_substring_regex(text, HINT), False).to_pylist()
            made = [replaced(t, p.key) if x else (t, None if t is None else []) for t, x in zip(text.to_pylist(), look)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string())]))
            return {"text": pa.array([t for t, _ in made], pa.string()), "pii": pa.array([e or [] for _, e in made], kind)}

        return compute

    order = [c for c in docs.columns if c.lower() != "pii"]
    out = common.mapped(docs, ADDED, make).select(*[f"`{c}`" for c in order], "pii")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


#: Known to all readers: for the registered query only, whose results are to repeat.
QUERY_KEY = b"pathloom: the registered query"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(common.table(spark, sf_dir, "documents"), PiiParams(QUERY_KEY))
