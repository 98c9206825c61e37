"""Surrogates for personal data.

Detected entities (mail addresses, phone numbers, IPv4 and IPv6 addresses, account and card-like numbers, secrets, personal names) get keyed replacements of the same
kind and format: digits for digits, letters of the same script and case, valid octets, Luhn digits where the original has them, given
names of the same gender and script. Equal entities (in any case) have equal surrogates everywhere: coreference stays. Of a
mail's domain the last label stays, and the whole of it where it is one of PROVIDERS; equal domains have equal surrogates.

A personal name is a given name and a family name, both capitalised, with particles (PARTICLES) between: a given name of NAMES, or
any after a title or another cue (CUES), before a verb of speech or the like (VERBS), or joined to such a name by "and" or a comma.
Given names beyond NAMES are of unknown gender and take one of either. Where a name has been found in a document, its given and
its family name alone are mentions of it, everywhere there, and take their part of its surrogate; of several names with that
part it is the one last named before. A family name alone after a title (TITLES) is a name, too.

Distinctness is checked over the whole corpus: distinct entities whose surrogates would coincide, with each other or with an
entity that occurs, are drawn again (all but the least) until none do. Where a format is used up the draws after the first
grow: longer local parts and family names, octets of any length, at last more digits; so the draws come to an end.

The finder runs once. What it found is kept for the rows that hold entities alone, and joined to the texts by row; that side
is broadcast only if it is at most BROADCAST_BYTES.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, small_enough, table

KEY, BROADCAST_ROWS, BROADCAST_BYTES = b"surrogates-1", 100_000, 16 << 20
#: Given names by (gender, script).
NAMES = {
    ("f", "latin"): ["Alice", "Anna", "Barbara", "Clara", "Diana", "Elena", "Emma", "Eva", "Hannah", "Helen", "Julia", "Laura", "Linda", "Maria", "Mary", "Nina", "Olivia", "Paula", "Sarah", "Susan"],
    ("m", "latin"): ["Adam", "Andrew", "Ben", "Charles", "Daniel", "David", "Eric", "Frank", "George", "Henry", "James", "John", "Lucas", "Mark", "Martin", "Michael", "Oliver", "Paul", "Peter", "Thomas"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "София", "Татьяна"],
    ("m", "cyrillic"): ["Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
}
_KIND = {n.lower(): k for k, names in NAMES.items() for n in names}
_VOWELS = {"latin": ("aeiou", "bcdfghjklmnprstvz"), "cyrillic": ("аеиоу", "бвгдклмнпрст")}
#: A family name: letters of any script with their accents, the first a capital; parts after hyphens too. An ending 's isn't part of it.
_CAPITAL = "[" + "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and c.isupper()) + "]"
PARTICLES = ["de", "del", "della", "da", "dos", "di", "la", "van", "von", "der", "den", "ter", "bin", "ibn", "al", "el"]
_WORD = rf"{_CAPITAL}(?:[^\W\d_]|[\u0300-\u036f]|['’](?![sS](?!\w))(?=[^\W\d_])|-(?={_CAPITAL}))+(?![\w\u0300-\u036f])"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) )*{_WORD}"
_PATTERNS = {
    "mail": r"(?<![\w.+-])[\w.+-]*\w@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z]{16,})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\dA-Za-z])\d{4}(?:[ -]?\d{4}){3}(?![\dA-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)|(?<![\w+.,/-])\(?0\d{2,4}\)?[ /-]\d{5,8}(?![\w-]|[.,]\d)",
    "name": rf"(?<!\w)(?:{'|'.join(x for names in NAMES.values() for n in names for x in (n, n.upper()))}) {_FAMILY}",
}
#: What stands before a name, after one, and between two; mail providers, whose domains name nobody; second-level labels of countries.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir"]
CUES = r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Dear|Signed|Sincerely|Regards|met|named|called|name is)[.,:]?\s"
VERBS = r"(?=(?:,? who)? (?:met|said|says|told|asked|wrote|replied|answered|called|lives|lived|works|worked|was born)(?!\w))"
#: Capitalised words that open sentences and aren't given names.
OPENERS = {"After", "And", "As", "Because", "Before", "But", "Even", "If", "Later", "Now", "Once", "Only", "Since", "So", "Then", "Though", "Today", "Until", "When", "Where", "While", "Yesterday", "Yet"}
JOINS = re.compile(r", and |, | and | & ")
PROVIDERS = {"gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "gmx.de", "gmx.net", "web.de", "mail.ru", "yandex.ru", "qq.com", "163.com", "protonmail.com"}
SECOND_LEVEL = {"ac", "co", "com", "edu", "gov", "net", "org"}
_PAIR = rf"(?<!\w){_CAPITAL}(?:[^\W\d_]|[\u0300-\u036f])+ {_FAMILY}"
_CUED, _SPEAKS, _AT_END, _HERE = re.compile(CUES), re.compile(VERBS), re.compile(_PAIR + "$"), re.compile(_PAIR)
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?P<family>{_FAMILY})(?! {_CAPITAL})")
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: Every match of _PATTERNS holds a match of this: a secret without digits is a prefixed one or 32 hex letters of one case.
_HINT = re.compile(r"[\d@]|::|(?:[A-Fa-f]{1,4}:){7}|(?:sk|pk|ghp|xox[bp])[-_]|[a-f]{32}|[A-F]{32}|" + "|".join(f"{x} " for names in NAMES.values() for n in names for x in (n, n.upper())))


def _last_words(text: str, end: int, n: int) -> int:
    """Where the n words before end begin, counted by single blanks."""
    at = end
    for _ in range(n):
        at = text.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at + 1


def _names(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """known (start, end, kind) and the names that their context tells, in order, without overlaps."""
    found = {(a, e) for a, e, kind in known if kind == "name"}
    for m in _CUED.finditer(text):
        if (got := _HERE.match(text, m.end())) and got[0].partition(" ")[0] not in OPENERS:
            found.add(got.span())
    for m in _SPEAKS.finditer(text):
        low = _last_words(text, m.start(), 5)
        if (got := _AT_END.search(text[low : m.start()])) and got[0].partition(" ")[0] not in OPENERS:
            found.add((low + got.start(), m.start()))
    todo = sorted(found)
    while todo:
        _, end = todo.pop()
        if (joint := JOINS.match(text, end)) and (got := _HERE.match(text, joint.end())) and got.span() not in found:
            found.add(got.span())
            todo.append(got.span())
    out: list[tuple[int, int, str]] = []
    for a, e, kind in sorted([k for k in known if k[2] != "name"] + [(a, e, "name") for a, e in found]):
        if not out or a >= out[-1][1]:
            out.append((a, e, kind))
    return out


def _alone(text: str, word: str) -> Iterator[int]:
    """Where a word stands by itself. What follows an apostrophe is another word only if it is an ending 's."""
    at = text.find(word)
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(word) : at + len(word) + 1]
        joined = before.isalnum() or before in ("_", "-", "'", "’", "@", ".") and bool(before) and not (before == "." and text[at - 2 : at - 1].isspace())
        if not joined and not (after.isalnum() or after in ("_", "-", "@") and after or unicodedata.combining(after or " ")) and not re.match(r"['’](?![sS](?!\w))\w", text[at + len(word) : at + len(word) + 2]):
            yield at
        at = text.find(word, at + len(word))


def _mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, str]]:
    """Parts of the names found, alone, and titled family names: (start, end, kind, form of the whole name, part)."""
    names = [(a, text[a:e]) for a, e, kind in found if kind == "name"]
    by_word: dict[str, list[tuple[int, str, str]]] = {}
    for a, name in names:
        given, _, family = name.partition(" ")
        for word, part in ((given, "given"), (family.rpartition(" ")[2], "last")):
            if len(word) > 1:
                for w in {word, word.capitalize() if word.isupper() else word.upper()}:
                    by_word.setdefault(w, []).append((a, canonical("name", name), part))
    out = []
    for word, whose in by_word.items():
        for at in _alone(text, word):
            before = [w for w in whose if w[0] <= at]
            _, form, part = before[-1] if before else whose[0]
            out.append((at, at + len(word), "name", form, part))
    for m in _TITLED.finditer(text):
        a, e = m.span("family")
        if text[a:e].rpartition(" ")[2] not in by_word:
            out.append((a, e, "name", " " + canonical("name", text[a:e]), "family"))
    return out


def spans(text: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, part) in order, without overlaps; part is empty but for the mentions of a part of a name."""
    found: list[tuple[int, int, str]] = []
    if text and _HINT.search(text):
        found = [(m.start(), m.end(), m.lastgroup) for m in _FIND.finditer(text)]
    more: list[tuple[int, int, str, str, str]] = []
    if text and (any(k == "name" for _, _, k in found) or _CUED.search(text) or _SPEAKS.search(text) or _TITLED.search(text)):
        found = _names(text, found)
        more = _mentions(text, found)
    end = 0
    whole = [(a, e, kind, canonical(kind, text[a:e]), "") for a, e, kind in found]
    taken = {x for a, e, *_ in whole for x in range(a, e)} if more else ()
    for x in sorted(whole + [m for m in more if m[0] not in taken and m[1] - 1 not in taken], key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            yield x
            end = x[1]


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of spans."""
    for a, e, kind, form, _ in spans(text):
        yield a, e, kind, form


def canonical(kind: str, value: str) -> str:
    """What equal entities share: digits alone for numbers, lower case for the rest."""
    if kind == "iban":
        return value.replace(" ", "").lower()
    return re.sub(r"\D", "", value) if kind in ("card", "phone", "ssn") else value.lower()


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, kind: str, form: str, turn: int):
        self.seed, self.n, self.left = f"{kind}\0{form}\0{turn}".encode(), 0, 0
        self.key = key

    def below(self, n: int) -> int:
        if self.left < 1 << 32:
            self.left = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "little"), key=self.key, digest_size=32).digest(), "little")
            self.n += 1
        self.left, r = divmod(self.left, n)
        return r


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10


def _check97(iban: str) -> str:
    """The two check digits of an account number whose own are 00."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97:02}"


def _swapped(s: _Stream, x: str) -> str:
    """A letter for each letter, of its script, and a digit for each digit."""
    def one(c: str) -> str:
        if c.isdigit():
            return str(s.below(10))
        if not c.isalpha():
            return c
        if c.isascii():
            return chr(97 + s.below(26))
        low = ord(c) & ~63
        near = [x for x in map(chr, range(low, low + 64)) if x.isalpha() and x.lower() == x and (x.isupper() or x.upper() != x) == (c.isupper() or c.upper() != c)]
        return near[s.below(len(near))] if near else c
    return "".join(map(one, x))


def surrogate(kind: str, form: str, turn: int, key: bytes = KEY) -> str:
    """The canonical surrogate of a canonical form. Draws from the third on grow by a character each, those of fixed formats from the ninth."""
    s = _Stream(key, kind, form, turn)
    more, late = max(0, turn - 1), max(0, turn - 7)
    if kind == "ip":
        old = form.split(".")
        octet = lambda x: s.below(256) if more else [s.below(10), 10 + s.below(90), 100 + s.below(156)][len(x) - 1]
        return ".".join(str(octet(x)) for x in [*old, *["0"] * late])
    if kind == "ip6":
        return "".join("0123456789abcdef"[s.below(16)] if c != ":" else c for c in form) + ":0" * late
    if kind == "iban":
        rest = "".join(str(s.below(10)) if c.isdigit() else chr(97 + s.below(26)) for c in form[4:] + "0" * late)
        return form[:2] + _check97(form[:2] + "00" + rest) + rest
    if kind == "name":
        given, _, family = form.partition(" ")
        letter = given[:1] or family.rpartition(" ")[2][:1]
        script = "cyrillic" if "а" <= letter <= "ё" else "latin" if unicodedata.name(letter, "").startswith("LATIN") else None
        gender, script = _KIND.get(given, (None, script))
        particles, _, family = family.rpartition(" ")  # these stay
        particles += " " * bool(particles)
        if script is None:
            return _swapped(s, given) + " " + particles + _swapped(s, family + family[-1:] * more)
        choices = [n.lower() for k, names in NAMES.items() if k[1] == script and gender in (None, k[0]) for n in names if n.lower() != given]
        vowels, others = _VOWELS[script]
        given = choices[s.below(len(choices))] if given else ""
        letters = [(others if i % 2 == 0 else vowels)[s.below(len(others if i % 2 == 0 else vowels))] for i in range(max(4, len(family)) + more)]
        return given + " " + particles + "".join(family[i] if family[i : i + 1] in ("-", "'", "’") else c for i, c in enumerate(letters))
    if kind in ("card", "ssn"):
        out = "".join(str(s.below(10)) for _ in form + "0" * late)
        if kind == "card" and _luhn(form) == 0:
            out = next(out[:-1] + str(d) for d in range(10) if _luhn(out[:-1] + str(d)) == 0)
        return out
    if kind == "phone":
        keep = max(0, len(form) - 10)  # the country's digits
        return form[:keep] + "".join(str(s.below(10)) for _ in form[keep:] + "0" * late)
    if kind == "secret":
        hexed = re.fullmatch("[0-9a-f]+", form)
        return "".join(c if c in "-_" or not hexed and i < 3 else "0123456789abcdef"[s.below(16)] if hexed else str(s.below(10)) if c.isdigit() else chr(97 + s.below(26)) for i, c in enumerate(form + "a" * late))
    local, _, domain = form.rpartition("@")
    local = _swapped(s, local) + "".join(chr(97 + s.below(26)) for _ in range(more))
    if domain not in PROVIDERS:
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 and labels[-2] in SECOND_LEVEL else 1
        own = _Stream(key, "domain", domain, 0)
        domain = ".".join([*[_swapped(own, x) for x in labels[:-keep]], *labels[-keep:]])
    return f"{local}@{domain}"


def dressed(kind: str, value: str, form: str, part: str = "") -> str:
    """A canonical surrogate, or a part of a name's, in the format of the value it replaces; what a longer one has more stands at its end."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(form.upper())
        return "".join(next(signs) if c.isalnum() else c for c in value) + "".join(signs)
    if kind == "name":
        given, family = form.split(" ", 1)
        if part:
            old, new = value, {"given": given, "family": family, "last": family.rpartition(" ")[2]}[part]
            return _cased(old, new)
        old_given, _, old_family = value.partition(" ")
        return _cased(old_given, given) + " " + _cased(old_family, family)
    if len(form) == len(value):
        return "".join(f.upper() if v.isupper() else f for f, v in zip(form, value, strict=True))
    return form


def _cased(old: str, new: str) -> str:
    """new with capitals where old has them, all through if old is all capitals."""
    if len(old) > 1 and old.isupper():
        return new.upper()
    return "".join(c.upper() if old[i : i + 1].isupper() else c for i, c in enumerate(new))


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string()), ("part", pa.string())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, text) -> doc_id, version, spans of the rows with entities."""
    for batch in batches:
        rows = [(d, v, got) for d, v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) if (got := [dict(zip(("start", "end", "kind", "form", "part"), e, strict=True)) for e in spans(t.as_py())])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(_SPAN))], names=["doc_id", "version", "spans"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [surrogate(k, f, t, key) for k, f, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["kind", "form", "turn", "new"])
    return run


def drawn_again(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """found (kind, form), distinct -> kind, form, turn > 0 of the entities that need another draw than the first to be distinct."""
    todo, turn = found.select("kind", "form", F.lit(0).alias("turn")), 0
    taken, again = None, None
    while True:  # each turn's draws come from a space many times the last one's
        new = checkpointed(todo.mapInArrow(_drawn(key), "kind string, form string, turn int, new string"))
        first = new.groupBy("kind", "new").agg(F.min("form").alias("form"))
        ok = new.join(first, ["kind", "new", "form"]).join(found.select("kind", F.col("form").alias("new")), ["kind", "new"], "left_anti")
        if taken is not None:
            ok = ok.join(taken, ["kind", "new"], "left_anti")
        ok = checkpointed(ok.select("kind", "new", "form", "turn"))
        taken = ok.select("kind", "new") if taken is None else taken.unionByName(ok.select("kind", "new"))
        settled = ok.where("turn > 0").select("kind", "form", "turn")
        again = settled if again is None else again.unionByName(settled)
        turn += 1
        todo = checkpointed(new.join(ok.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form", F.lit(turn).alias("turn")))
        if todo.isEmpty():
            return again


_OUT = "doc_id long, n_entities long, kinds string, text string"


def _rewritten(key: bytes):
    """(doc_id, text, spans) -> the rows with their entities replaced; spans are null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = batch.column(1).to_pylist(), [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                out, at, seen, text = [], 0, {}, texts[i]
                for x in sorted(spans or [], key=lambda x: x["start"]):
                    new = dressed(x["kind"], text[x["start"] : x["end"]], surrogate(x["kind"], x["form"], x["turn"], key), x["part"])
                    out += [text[at : x["start"]], new]
                    at, seen[x["kind"]] = x["end"], seen.get(x["kind"], 0) + 1
                if seen:
                    texts[i] = "".join(out) + text[at:]
                counts.append(sum(seen.values()))
                kinds.append(",".join(f"{k}={n}" for k, n in sorted(seen.items())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "kinds", "text"])
    return run


def with_surrogates(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, n_entities, kinds, text (rewritten): a row for each row of documents.

    Null texts stay null, empty ones empty; repeated rows give equal rows; null ids stay and their rows are treated like any
    other; rows that repeat a doc_id with another text are told apart by it; an empty table gives no rows; extra columns are ignored.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("version"), "text")
    found = checkpointed(docs.mapInArrow(_found, "doc_id long, version long, spans array<struct<start:int,end:int,kind:string,form:string,part:string>>"))
    each = found.select("doc_id", "version", F.inline("spans"))
    again = checkpointed(drawn_again(each.select("kind", "form").distinct(), key))
    near = F.broadcast(again) if small_enough(again, BROADCAST_ROWS) else again
    span = F.struct("start", "end", "kind", "form", "part", F.coalesce("turn", F.lit(0)).alias("turn"))
    by_row = checkpointed(each.join(near, ["kind", "form"], "left").groupBy("doc_id", "version").agg(F.collect_set(span).alias("spans")))
    size = by_row.agg(F.sum(F.aggregate("spans", F.lit(64).cast("long"), lambda a, x: a + 64 + F.octet_length(x["form"])))).first()[0] or 0
    by_row = by_row.withColumnsRenamed({"doc_id": "d", "version": "v"})
    if size <= BROADCAST_BYTES:
        by_row = F.broadcast(by_row)
    out = docs.join(by_row, docs["doc_id"].eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_rewritten(key), _OUT)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"))
