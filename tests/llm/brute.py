"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size):
    found = words(lower(text))
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def near_duplicates(rows, size, percent=80):
    """{doc_id: (n_shingles, component_id)} for distinct doc_ids."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        for o in {o for s in sets[d] for o in holders[s] if o < d}:
            both = len(sets[d] & sets[o])
            if 100 * both >= percent * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(rows):
    """{doc_id: edited text} for distinct doc_ids."""
    rows = sorted(rows)
    out = {}
    for k, (d, text) in enumerate(rows):
        text = text or ""
        other = rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        out[d] = text[: len(text) - n] + other[:n]
    return out


def quality(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, places = {}, set()
    for i in range(len(found) - 4):
        seen.setdefault(tuple(found[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {i + k for i in at for k in range(5)}
    n, again = len(found), len(places)
    return (
        n,
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        again,
        n < 10 or 100 * again > 20 * n,
    )


def luhn(digits):
    odd = digits[-1::-2]
    even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def personal(text):
    """Base spans by the contract's plain patterns."""
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    names = ("email", "ip", "card", "phone")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = tuple(sum(k == n for _, k, _ in spans) for n in range(4))
    return counts, hashlib.sha256(joined.encode()).hexdigest(), joined


def repeated(rows, size):
    """{doc_id: word positions in runs of `size` words that another document holds}."""
    holders = {}
    split = {d: words(t) for d, t in rows}
    for d, found in split.items():
        for i in range(len(found) - size + 1):
            holders.setdefault(tuple(found[i : i + size]), set()).add(d)
    out = {}
    for d, found in split.items():
        places = set()
        for i in range(len(found) - size + 1):
            if len(holders[tuple(found[i : i + size])]) > 1:
                places |= set(range(i, i + size))
        if places:
            out[d] = places
    return out


def piece_rows(rows, tokenizer, limit):
    out = []
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), limit)):
            part = ids[start : start + limit]
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            out.append((d, k, start, len(part), zlib.crc32(raw)))
    return out


def site(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    rules = [
        ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
        ("block", "net/es/"), ("block", "net/fr/"),
    ]
    best = (0, None, None)
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        fits = host == name or host.endswith("." + name)
        if fits and path.startswith("/" + start):
            best = max(best, (len(rule), rule, verdict))
    return host, path, best[1], best[2]


def served(quota, slots):
    """Earliest deadline first over one round."""
    done, out = [0] * len(quota), []
    for t in range(slots):
        due = [
            (-(-(done[k] + 1) * slots // q), k)
            for k, q in enumerate(quota)
            if done[k] < q and done[k] * slots // q <= t
        ]
        k = min(due)[1]
        done[k] += 1
        out.append(k)
    return out
