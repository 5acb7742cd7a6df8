"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(rows, min_docs=10):
    """doc_id, n_lines, n_dropped, kept_sha256 of rows (doc_id, text)."""
    keys = [[lower(x).strip(SPACES) for x in (t or "").split("\n")] for _, t in rows]
    seen = Counter(k for own in keys for k in set(own) if k)
    out = []
    for (doc, text), own in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((text or "").split("\n"), own, strict=True) if seen[k] < min_docs]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def secrets(text):
    """(start, kind, end) of the fixed patterns, scanning by hand."""
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    found, i = [], 0
    while i < len(text):
        end = None
        for name in names:
            if lower(text[i : i + len(name)]) != name:
                continue
            # every way to take the optional quotes, longest first
            for quote in (1, 0):
                j = i + len(name)
                if quote and text[j : j + 1] not in ("'", '"'):
                    continue
                j += quote
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
                    j += 1
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    end = (j, k)
                    break
            if end:
                break
        if end:
            if end[1] - end[0] >= 6:
                found.append((i, 0, end[1]))
            i = end[1]
        else:
            i += 1
    for kind, chars, prefix, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), (2, "0123456789abcdef", "", 24)):
        i = 0
        while i < len(text):
            if text.startswith(prefix, i) and text[i + len(prefix) : i + len(prefix) + 1] and text[i + len(prefix)] in chars:
                j = i + len(prefix)
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - i >= least:
                    found.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(found)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, own = text or "", words(text)
    at = defaultdict(list)
    for i in range(len(own) - 7):
        at[tuple(own[i : i + 8])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(8)}
    full = [x for x in text.split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered)


def is_date(s):
    """Year, month and day in any of three orders, digit by digit."""
    separators = {c for c in s if not c.isdigit()}
    if len(separators) > 1 or not s.isascii() or separators - set("-/._"):
        return False
    for order in ("ymd", "dmy", "mdy"):
        if separators:
            parts = s.split(next(iter(separators)))
            found = [dict(zip(order, parts, strict=True))] if len(parts) == 3 else []
        else:
            cut = {8: 4, 6: 2}.get(len(s))
            widths = [cut if k == "y" else 2 for k in order] if cut else []
            at = [sum(widths[:k]) for k in range(4)] if cut else []
            found = [{k: s[at[x] : at[x + 1]] for x, k in enumerate(order)}] if cut else []
        for f in found:
            year = len(f["y"]) == 2 or (len(f["y"]) == 4 and f["y"][:2] in ("19", "20"))
            if year and all(1 <= len(f[k]) <= 2 for k in "md") and 1 <= int(f["m"]) <= 12 and 1 <= int(f["d"]) <= 31:
                return True
    return False


def guess_cost(value, ranks, near):
    """Least log10 guesses, by trying every segment of the value as every kind."""
    fold = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    leet = dict(zip("013457@$!", "oleastasi", strict=True))
    classes = lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 4 if c in "_-. " else 9 if c in "(){}[]<>$" else 33 if c.isascii() else 100

    def kinds(s):
        low = fold(s)
        yield sum(math.log10(classes(c)) for c in s)
        for form, factor in ((low, 1), ("".join(leet.get(c, c) for c in low), 2)):
            if 2 <= len(s) <= 24 and form in ranks:
                yield math.log10(ranks[form] * factor * (1 if s == low else 2) + 1)
        if is_date(s):
            yield math.log10(365 * 120)
        if len(s) == 4 and s.isascii() and s.isdigit() and s[:2] in ("19", "20"):
            yield math.log10(120)
        if all(c in near for c in low) and all(b in near[a] for a, b in zip(low, low[1:], strict=False)):
            yield math.log10(47 * 2) + (len(s) - 1) * math.log10(1.6)
        for b in range(1, min(24, len(s) // 2) + 1):
            if len(s) % b == 0 and s == s[:b] * (len(s) // b):
                yield guess_cost(s[:b], ranks, near) + (len(s) // b - 1) * math.log10(1.2)

    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            best[j] = min(best[j], best[i] + (math.log10(2) if i else 0) + min(kinds(value[i:j])))
    return best[-1]


def beta_prior(hosts, rounds=4, even_hosts=10):
    """Alpha and beta of hosts (documents, failures), host by host."""
    mean = rho = 0.0
    for _ in range(rounds):
        weights = [n / (1 + rho * (n - 1)) for n, _ in hosts]
        total = sum(weights)
        mean = min(max(sum(w * k / n for w, (n, k) in zip(weights, hosts, strict=True)) / total, 1e-6), 1 - 1e-6)
        centre = sum(w * k / n for w, (n, k) in zip(weights, hosts, strict=True)) / total
        spread = sum(w * (k / n - centre) ** 2 for w, (n, k) in zip(weights, hosts, strict=True))
        # Variance of a host's rate: mean (1 - mean) (1 / n + rho (1 - 1 / n)).
        noise = sum(w * (1 - w / total) / n for w, (n, _) in zip(weights, hosts, strict=True))
        signal = sum(w * (1 - w / total) * (1 - 1 / n) for w, (n, _) in zip(weights, hosts, strict=True))
        rho = 0.0
        if signal > 1e-9 * total:
            told = [w * (1 - 1 / n) for w, (n, _) in zip(weights, hosts, strict=True)]
            seen = sum(told) ** 2 / sum(x * x for x in told)
            rho = min(0.99, max(0.0, (spread / (mean * (1 - mean)) - noise) / signal) * seen / (seen + even_hosts))
    strength = min(1 / rho - 1, 1e6) if rho else 1e6
    return mean * strength, (1 - mean) * strength


def substrings(rows, window=20):
    """doc_id, n_words, n_removed, kept_sha256 of rows (doc_id, text)."""
    first = {}
    order = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            key, place = tuple(own[i : i + window]), (order(doc), i)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = {i + j for i in range(len(own) - window + 1) if first[tuple(own[i : i + window])] < (order(doc), i) for j in range(window)}
        kept = [w for i, w in enumerate(own) if i not in gone]
        out.append((doc, len(own), len(gone), sha(" ".join(kept))))
    return out


def shingles(text, n=5):
    own = words(lower(text or ""))
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def components(rows, percent):
    """doc_id -> (set size, least doc_id reachable)."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edit_distance_within(pattern, text):
    """Least word edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def crc(data):
    return zlib.crc32(data)
