"""Personal data: fixed patterns, and weakly supervised spans beside them.

Candidates beside the patterns are proposed by every family of labelers: words with a
digit, assigned values and grouped numbers by their shape, runs of capitalised words
that begin with a given name by the gazetteer, words after a cue or a form of address by
their context. All labelers vote personal, not personal or nothing on each. How often
every combination of votes occurs in the whole corpus, a bounded table, goes to
expectation-maximisation, which estimates how reliable each labeler is and how likely
personal data is under each combination. With these likelihoods as targets a logistic
classifier on the candidate's shape and its preceding word is trained on a bounded
sample, and decides which candidates become spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.llm import words as W

KINDS = ("email", "ip", "card", "phone")
#: Kinds of further spans: keys and passwords, people, accounts and numbers of persons.
MORE_KINDS = ("secret", "person", "account")
#: Candidates that train the classifier (lowest hashes first), its inputs, its verdict.
SAMPLE = 20_000
FEATURES = 512
ACCEPT = 0.9

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: Signs around a candidate that are not part of it.
_OPENS, _CLOSES = "\"'([{<#*&$|", ".,;:!?)\"'#*&$|>]}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time proportional to the text: from one @ to the next."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
        done = match.end() if match else at + 1
        at = text.find("@", done)


def _parts(address: str) -> list[str]:
    """Parts without leading zeros, of which there may be more digits than a number takes."""
    return [p.lstrip("0") for p in address.split(".")]


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in _parts(m[0])):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            yield m.span()


_FINDERS = (emails, ips, cards, phones)

# Labelers: +1 personal, -1 not personal, 0 no opinion.
_ASSIGNED = re.compile(r"(?i)(pass(word|wd)?|pwd|token|secret|api[_-]?key|pin|ssn)[=:].{4,}")
_ACCESS = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}\b")
_NUMBERED = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
_PLAIN = re.compile(r"v?[^A-Za-z]+(st|nd|rd|th)?")
_PREFIXES = ("akia", "asia", "sk-", "sk_", "ghp_", "gho_", "xoxb", "xoxp", "eyj", "glpat")
_FIELDS = ("password", "passwd", "pwd", "token", "secret", "key", "ssn", "iban", "passport")
_ASKS = frozenset("password passwd pwd token secret key ssn iban passport account konto compte".split())
_HANDS = frozenset("password passwd pwd passphrase passwort contraseña token secret pin".split())
_TITLES = frozenset(
    "mr mrs ms miss dr prof sir madam herr frau señor señora sr sra monsieur madame mme mlle don doña".split()
)
#: Given names common in the four languages of the corpus.
_GIVEN = frozenset(
    """
    james john robert michael william david richard joseph thomas charles daniel matthew anthony mark
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emily emma alice anna laura
    hans peter klaus jürgen stefan andreas wolfgang markus sebastian florian lukas felix jonas
    ursula monika petra sabine claudia katrin stefanie anja heike birgit greta lena johanna
    jean pierre michel philippe jacques françois louis nicolas julien antoine olivier guillaume
    marie nathalie isabelle sophie catherine camille chloé juliette margaux céline aurélie
    josé juan carlos luis javier miguel manuel fernando diego pablo sergio alejandro rafael
    maría carmen ana lucía marta elena isabel pilar rosa teresa sofía paula cristina
    """.split()
)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_CAPITALISED = re.compile(r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*")
#: Numbers that blanks split: account numbers by country, social security numbers.
_GROUPED = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,4})?|[0-9]{3} [0-9]{2} [0-9]{4})(?![A-Za-z0-9])"
)
#: Rows without any of these hold neither a fixed pattern nor a candidate.
_ANY = "|".join(["[0-9@]", *sorted(f"(?i:{w})" for w in _HANDS | _TITLES | _GIVEN)])
_COUNTS = frozenset(
    "version license section chapter page figure table no nr vol part cc in of the year article".split()
)
_BITS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")


def _named(word: str, before: str) -> int:
    return 1 if _ASSIGNED.match(word) else 0


def _patterned(word: str, before: str) -> int:
    return 1 if _ACCESS.match(word) or _NUMBERED.fullmatch(word.rstrip(".,;:")) else 0


def _number(word: str, before: str) -> int:
    return -1 if _PLAIN.fullmatch(word) else 0


def _listed(word: str, before: str) -> int:
    low = word[:24].lower()
    return 1 if low.startswith(_PREFIXES) or low.startswith(_FIELDS) else 0


def _scrambled(word: str, before: str) -> int:
    core = word.rpartition("=")[2].lstrip(_OPENS).rstrip(_CLOSES)
    digits = sum(c.isdigit() for c in core)
    if len(core) >= 14 and digits >= 3 and core.isalnum() and digits < len(core):
        return 1
    return -1 if len(core) < 6 else 0


def _asked(word: str, before: str) -> int:
    low = before.lower()
    if low.endswith((":", "=")) or low.strip(".,;:=") in _ASKS:
        return 1
    return -1 if low.strip(".,;:=") in _COUNTS else 0


def _given(word: str, before: str) -> int:
    names = word.split(" ")
    return 1 if len(names) > 1 and names[0].lower() in _GIVEN else 0


def _addressed(word: str, before: str) -> int:
    return 1 if before.lower().strip(".,;:(") in _TITLES and word[:1].isupper() else 0


def _grouped(word: str, before: str) -> int:
    return 1 if " " in word and _GROUPED.fullmatch(word) else 0


def _handed(word: str, before: str) -> int:
    return 1 if before.lower().strip(".,;:=\"'(") in _HANDS and before[-1:] in ":=" else 0


LABELERS = (
    _named, _patterned, _number, _listed, _scrambled, _asked, _given, _addressed, _grouped, _handed
)


def votes(word: str, before: str) -> int:
    """All labelers' votes as one number, a base-3 digit each."""
    total = 0
    for labeler in LABELERS:
        total = total * 3 + labeler(word, before) + 1
    return total


def features(word: str, before: str) -> np.ndarray:
    """Indices of the classifier's inputs that are on."""
    core = word[:64]
    shape = [
        f"{'a' if b[0].isalpha() else '0' if b[0].isdigit() else b[:2]}{min(len(b), 20) // 4}"
        for b in _BITS.findall(core)
    ]
    marks = [
        "bias", f"n{min(len(word), 64) // 8}", f"start {core[:4].lower()}", f"first {shape[:1]}",
        f"digits {4 * sum(c.isdigit() for c in core) // len(core)}", f"before {before[-24:].lower()}",
        *(f"pair {a} {b}" for a, b in zip(shape, shape[1:])),
    ]
    return np.unique([xxhash.xxh3_64_intdigest(m) % FEATURES for m in marks])


def estimate(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Chance of personal data under each combination of votes, by expectation-maximisation.

    Two classes; given the class, labelers vote independently. Starts from the majority
    of votes; a Beta-like pseudo-count keeps shares off 0 and 1.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    cast = np.array([[k // 3**p % 3 for p in range(len(LABELERS))] for k in keys])
    lean = (cast - 1).sum(1)
    chance = 1 / (1 + np.exp(-2.0 * lean + 0.5))
    for _ in range(rounds):
        logs = []
        for mass in (weight * chance, weight * (1 - chance)):
            log = np.full(len(keys), math.log((mass.sum() + 1) / (weight.sum() + 2)))
            for p in range(len(LABELERS)):
                share = np.bincount(cast[:, p], mass, minlength=3) + 0.5
                log += np.log(share / share.sum())[cast[:, p]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        moved = np.abs(new - chance).max()
        chance = new
        if moved < 1e-9:
            break
    # The classes have no names of their own: personal is the one that voted so.
    if (weight * chance) @ lean * ((1 - chance) @ weight) < (weight * (1 - chance)) @ lean * (
        chance @ weight
    ):
        chance = 1 - chance
    return dict(zip(keys, chance.tolist()))


def train(rows: list[tuple[str, str, int, int]], chances: dict[int, float]) -> np.ndarray:
    """Logistic weights on soft targets, by gradient steps on all rows at once.

    A row is (word, before, votes, count): a candidate that repeats weighs more, but less
    than its share.
    """
    weights = np.zeros(FEATURES)
    if not rows:
        weights[features("0", "")] = -10.0
        return weights
    inputs = np.zeros((len(rows), FEATURES), np.float32)
    for k, (word, before, *_) in enumerate(rows):
        inputs[k, features(word, before)] = 1
    target = np.array([chances[v] for *_, v, _ in rows])
    heft = np.sqrt([n for *_, n in rows])
    heft /= heft.sum()
    scale = np.sqrt(heft @ inputs**2) + 0.05
    for _ in range(400):
        score = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        weights -= 0.5 * (inputs.T @ (heft * (score - target)) / scale + 1e-5 * weights)
    return weights


def _proposed(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, span, word before): what any family of labelers points to."""
    for m in _GROUPED.finditer(text):
        before = text[: m.start()].rsplit(None, 1)[-1:] if m.start() < 200 else text[m.start() - 100 : m.start()].rsplit(None, 1)[-1:]
        yield m.start(), m.end(), "account", m[0], "".join(before)
    before, name = "", []
    words = [(m.start(), m[0]) for m in _WORDS.finditer(text)]
    for k, (at, word) in enumerate(words):
        start = at + len(word) - len(word.lstrip(_OPENS))
        end = at + len(word.rstrip(_CLOSES))
        if start < end:
            core = text[start:end]
            low, cue = core.lower(), before.lower().strip(".,;:=\"'(")
            if _DIGITS.search(word) or _ASSIGNED.match(core):
                yield start, end, "secret", word, before
            elif cue in _HANDS and before[-1:] in ":=" and len(core) >= 4:
                yield start, end, "secret", core, before
            elif before in (":", "=") and k > 1 and len(core) >= 4:
                cue = words[k - 2][1]
                if cue.lower().strip(".,;\"'(") in _HANDS:
                    yield start, end, "secret", core, cue + before
            if (low in _GIVEN and core[0].isupper()) or (cue in _TITLES and core[0].isupper()):
                last = _name_end(words, k, end)
                if last > end or cue in _TITLES:
                    yield start, last, "person", text[start:last], before
        before = word


def _name_end(words: list[tuple[int, str]], first: int, end: int) -> int:
    """Where a name that begins with word `first` ends: up to two more capitalised words."""
    for k in range(first + 1, min(first + 3, len(words))):
        if words[k - 1][1][-1] in _CLOSES:
            break
        at, word = words[k]
        core = word.rstrip(_CLOSES)
        if not _CAPITALISED.fullmatch(core):
            break
        end = at + len(core)
    return end


def _found(text: str | None) -> tuple[list, list]:
    """Base spans (start, kind number, end), and candidates (start, end, kind, word, before,
    votes) that no base span touches and no candidate before them."""
    if not text:
        return [], []
    spans = [(a, k, b) for k, finder in enumerate(_FINDERS) for a, b in finder(text)]
    spans.sort()
    taken = sorted((a, b) for a, _, b in spans)
    candidates, reach, done, at = [], 0, 0, 0
    order = {k: n for n, k in enumerate(("account", "person", "secret"))}
    for start, end, kind, word, before in sorted(_proposed(text), key=lambda c: (c[0], order[c[2]])):
        while at < len(taken) and taken[at][0] < end:
            reach, at = max(reach, taken[at][1]), at + 1
        if max(reach, done) <= start < end:
            # Labelers and classifier read bounded beginnings of what was found.
            seen = votes(word, before[-64:])
            candidates.append((start, end, kind, word[:64], before[-64:], seen))
            done = end
    return spans, candidates


_FOUND = (
    "doc_id long, spans array<struct<start: long, kind: int, end: long>>, "
    "candidates array<struct<start: long, end: long, kind: string, word: string, before: string, votes: int>>"
)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {
        "spans": pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])),
        "candidates": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("word", pa.string()), ("before", pa.string()), ("votes", pa.int32())])),
    }
    names = {k: [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)] for k, kind in kinds.items()}
    for batch in batches:
        for part in W.slices(batch):
            some = pc.fill_null(pc.match_substring_regex(part.column("text"), _ANY), False)
            out = {"spans": [[] for _ in range(len(part))], "candidates": [[] for _ in range(len(part))]}
            for k in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
                for name, rows in zip(out, _found(part.column("text")[k].as_py())):
                    out[name][k] = [dict(zip(names[name], row)) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(out[k], kinds[k]) for k in kinds]],
                names=["doc_id", *kinds],
            )


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def _decide(weights: np.ndarray):
    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, spans, candidates in zip(frame.doc_id, frame.spans, frame.candidates):
                base = [(s["start"], s["kind"], s["end"], KINDS[s["kind"]]) for s in spans]
                more = []
                for c in candidates:
                    score = weights[features(c["word"], c["before"])].sum()
                    if score >= math.log(ACCEPT / (1 - ACCEPT)):
                        place = len(KINDS) + MORE_KINDS.index(c["kind"])
                        more.append((c["start"], place, c["end"], c["kind"]))
                counts = np.bincount([k for _, k, _, _ in base], minlength=len(KINDS)).tolist()
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc, *counts, digest, _joined(base + more), len(base + more)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype(
                {"doc_id": "Int64"}
            )

    return decide


_RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string, n_spans long"
)


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; those of
    the kinds `secret`, `person` and `account` are the classifier's and never overlap a
    fixed pattern's or each other. n_spans counts all spans. Null and
    empty texts have none (an empty string, and the digest of one). Without candidates
    nothing is trained and only the patterns count. Rows that repeat a doc_id, or have
    a null one, are searched one by one. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    found = cut(texts.mapInArrow(_search, _FOUND), "spans")
    single = found.select(F.explode("candidates").alias("c")).select("c.*")
    # At most 3 to the number of labelers rows.
    counts = {r["votes"]: r["count"] for r in single.groupBy("votes").count().collect()}
    rows = (
        single.groupBy("word", "before", "votes")
        .count()
        .orderBy(F.xxhash64("word", "before"), "word", "before", "votes")
        .limit(sample)
        .collect()
    )
    weights = train([tuple(r) for r in rows], estimate(counts))
    return found.mapInPandas(_decide(weights), _RESULT)


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end), a row for each span of `personal_data`."""
    span = F.split("span", ":")
    return (
        personal_data(docs)
        .where("spans <> ''")
        .select("doc_id", F.explode(F.split("spans", ",")).alias("span"))
        .select(
            "doc_id",
            span[0].alias("kind"),
            span[1].cast("long").alias("start"),
            span[2].cast("long").alias("end"),
        )
    )
