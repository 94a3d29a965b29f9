"""Plain versions of the operators' contracts for small inputs."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST = -(2**63)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def order(i):
    return LEAST if i is None else i


def substring(docs, window=50):
    owner = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            owner[x] = min(owner.get(x, order(i)), order(i))
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k:k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def lines(docs, min_docs=3, min_chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)

    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(order(i))
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != order(i))]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def simhash(docs, radius=4):
    prints = []
    for _, t in docs:
        w = words((t or "").translate(LOWER))
        grams = [" ".join(w[k:k + 4]) for k in range(max(len(w) - 4, 0) + 1)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, f"{p:016x}", least.get(find(a))) for a, ((i, _), p) in enumerate(zip(docs, prints))]


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()


def jaccard(docs, percent=80):
    """(id, smallest id of the group) by comparing all pairs of shingle sets."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, least.get(find(a))) for a, (i, _) in enumerate(docs)]


def contaminated(docs, items, window=10):
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(t):
        return pattern.findall((t or "").translate(LOWER))

    found = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            found.setdefault(tuple(w[k:k + window]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                here = found.get(tuple(w[k:k + size]))
                if here is not None:
                    hit.update(range(k, k + size))
                    ids |= here
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def language_model(docs, s2, s3):
    tokens = [(i, words((t or "").translate(LOWER)) + ["</s>"]) for i, t in docs]

    def held(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2

    uni, bi, tri, first, second = (Counter() for _ in range(5))
    for i, w in tokens:
        if not held(i):
            s = ["<s>", "<s>", *w]
            for k in range(2, len(s)):
                uni[s[k]] += 1
                bi[s[k - 1], s[k]] += 1
                tri[s[k - 2], s[k - 1], s[k]] += 1
                first[s[k - 1]] += 1
                second[s[k - 2], s[k - 1]] += 1
    total, distinct = sum(uni.values()), len(uni)
    out = []
    for i, w in tokens:
        s, base, score = ["<s>", "<s>", *w], 0.0, 0.0
        for k in range(2, len(s)):
            u, v, x = s[k - 2:k + 1]
            p1 = (uni[x] + 1) / (total + distinct + 1)
            p2 = (bi[v, x] + s2 * p1) / (first[v] + s2)
            p3 = (tri[u, v, x] + s3 * p2) / (second[u, v] + s3)
            base += math.log10(p1)
            score += math.log10(p3)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out


def quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = words(t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        count, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                covered |= {k, k + 1, k + 2}
        full = [x for x in t.split("\n") if words(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)),
                    len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return out


def vote_posteriors(votes, passes=100, least=0.001):
    """Posterior of good quality for each document, by passes over the documents themselves."""
    prior, good_rate, bad_rate = 0.85, [0.95] * len(votes[0]), [0.5] * len(votes[0])

    def posterior(v):
        good, bad = prior, 1 - prior
        for x, a, b in zip(v, good_rate, bad_rate):
            good *= {1: a, -1: 1 - a, 0: 1}[x]
            bad *= {1: 1 - b, -1: b, 0: 1}[x]
        return good / (good + bad)

    for _ in range(passes):
        p = [posterior(v) for v in votes]
        before, prior = prior, min(max(sum(p) / len(p), 0.05), 0.95)
        for j in range(len(good_rate)):
            cast = [(g, v[j]) for g, v in zip(p, votes) if v[j]]
            good_rate[j] = min((sum(g for g, x in cast if x > 0) + 1) / (sum(g for g, _ in cast) + 2), 1 - least)
            bad = (sum(1 - g for g, x in cast if x < 0) + 1) / (sum(1 - g for g, _ in cast) + 2)
            bad_rate[j] = min(max(bad, 1 - good_rate[j] + least), 1 - least)
        if abs(prior - before) < 1e-9:
            break
    return [posterior(v) for v in votes]


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def secrets(docs):
    out = []
    for i, t in docs:
        found = sorted((m.start(), o, k, m.end()) for o, (k, p, g, n) in enumerate(SECRETS)
                       for m in p.finditer(t or "") if len(m.group(g)) >= n)
        out.append((i, *[sum(f[1] == o for f in found) for o in range(3)],
                    sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    return out


def plain_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def importance(docs, items, order=1, buckets=10_000, percent=10, min_words=20):
    def hashed(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[k:k + n]).encode()) % buckets for n in range(1, order + 1) for k in range(len(w) - n + 1)]

    raw, target = (Counter(b for _, t in rows for b in hashed(t)) for rows in (docs, items))
    s_all, t_all = sum(raw.values()), sum(target.values())
    out = []
    for i, t in docs:
        found = hashed(t)
        gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
                for b in found]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [k for k, (_, t) in enumerate(docs) if len(plain_words(t)) >= min_words]
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0]))
    for place, k in enumerate(able[:percent * len(able) // 100]):
        out[k][4] = place + 1
    return [tuple(x) for x in out]


def alignment(docs, byte_vocabulary, piece_model):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_vocabulary)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in visible} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in visible)}

    def raw_a(i):
        return bytes(letter[c] for c in library.id_to_token(i))

    def raw_b(i):
        piece = pieces.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    found, count = [], Counter()
    for i, t in docs:
        a, b = library.encode(" " + (t or ""), add_special_tokens=False).ids, pieces.encode(t or "")
        joined = (b" " + (t or "").encode())
        if not t or b"".join(map(raw_a, a)) != joined or b"".join(map(raw_b, b)) != joined:
            a, b = [], []
        ends = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, out = 0, []
            for x in ids:
                at += len(raw(x))
                out.append(at)
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in shared]
        for side, ids in enumerate((a, b)):
            for x, e in zip(ids, ends[side]):
                groups[bisect.bisect_left(shared, e)][side].append(x)
        count.update((x[-1], y[-1]) for x, y in groups)
        found.append((i, a, b, groups))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, a, b, groups in found:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(groups), sum(count[p] == best[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), sha(written) if groups else ""))
    return out


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def personal_spans(text):
    def good(kind, found):
        digits = [int(c) for c in found if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            check = sum(d if n % 2 == 0 else sum(map(int, str(2 * d))) for n, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and check % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), o, k, m.end()) for o, (k, p) in enumerate(PERSONAL) for m in p.finditer(text or "")
                  if good(k, m.group()))


def disclosures(docs, reach):
    """(entity, word) -> (contexts, disclosure) from pairs of entity and word counted one by one."""
    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    near, windows, held, documents = Counter(), {}, Counter(), Counter()
    for _, t in docs:
        t = t or ""
        spans = personal_spans(t)
        every = [(m.start(), m.end(), m.group().translate(LOWER), not any(a < m.end() and m.start() < b for a, _, _, b in spans))
                 for m in word.finditer(t)]
        documents.update({w for _, _, w, _ in every})
        ids = [(k, t[a:b].lower() if k in ("email", "ip") else "".join(filter(str.isdigit, t[a:b]))) for a, _, k, b in spans]
        held.update(set(ids))
        pairs = set()
        for e, (a, _, _, b) in zip(ids, spans):
            window = [x for x in every if x[1] <= a][-reach:] + [x for x in every if x[0] >= b][:reach]
            window = frozenset(w for _, _, w, free in window if free)
            for w in window:
                windows.setdefault((e, w), set()).add(window)
                pairs.add((e, w))
        near.update(pairs)
    out = {}
    for (e, w), n in near.items():
        content = math.log2(len(docs) / held[e])
        out[e, w] = len(windows[e, w]), 1 + math.log2(n / documents[w]) / content if content else 0.0
    return out
