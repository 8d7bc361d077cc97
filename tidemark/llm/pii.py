"""Personal data: plain patterns for four kinds, and a linear-chain CRF over word shapes that adds what they miss.

Tokens are runs without white space. A token's emission is the sum of weights for its own shape, digit count and cue
word and for the shapes beside it; labels are O and begin or inside of each kind. The weights are trained on the small
table of `labelled_lines` by Adam on the forward-backward gradient. Viterbi runs in numpy over all open stretches of a
block at once: a token
whose O beats every label by more than its neighbours and transitions could ever add is O for certain, which cuts the
chain there without changing the best path.

Defined cases: null text is empty and has no spans; texts of any length are read whole; offsets count code points, ends
are exclusive; spans of the CRF that overlap a plain one are dropped; repeated rows are each read; a table without rows gives an empty
result; `find` keeps further columns, but for those named like what it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Numbered, blocks, small_batches, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BLOCK_BYTES = 2 << 20
STEPS, RATE, PENALTY = 250, 0.1, 2e-3

# Training table: lines in which [kind:...] marks personal data. Fixed values; the lines with a {} take the forms below in turn.
NAMES = ("anna", "j.doe", "bob77", "maria_lopez", "k.w-2", "Jane.Roe", "info", "h")
HOSTS = ("example.org", "mail.example.com", "firm-a.de", "uni.example.edu", "example.co.uk")
EMAIL_FORMS = (
    "{n}(at){h}", "{n}[at]{h}", "{n} (at) {h}", "{n} [at] {h}", "{n} at {w}", "{n}@{h}", "{n} @ {h}", "{n} AT {w}", "{n}(at){d}", "{n} [at] {d}",
)
PHONE_FORMS = (
    "(030) 555-0199", "555-123-4567", "(415) 555-2671", "020 7946 0958", "+1 (212) 555-0123", "+44 20 7946 0991", "800-555-0175", "0171/5550142",
    "030 5550199", "1-800-555-0100", "555.123.4567", "+49 (0)30 555 0177", "(0)30 555 0134", "0171 555 01 42",
)
IP_FORMS = ("10.20.30.40", "192.168.0.1", "10[.]0[.]0[.]7", "172.16.5[.]9", "8.8.4.4", "203.0.113.200")
CARD_FORMS = ("4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "4222.2222.2222.2220", "3400 000000 00009", "6011/0000/0000/0004")
CARRIERS = {
    "email": (
        "please write to {} before noon", "reach me under {} or not at all", "mail {} for the list", "her address is {} since june", "contact: {} thanks",
        "send it to {}, and wait", "questions go to {}.", "{} answers within a day", "we gave {} to the office at the gate",
    ),
    "phone": (
        "call {} after six", "tel: {} or ask at the door", "phone {} now", "fax {} is out of order", "my number is {} at home", "ring {} once",
        "reach us: {} day and night", "you can call me on {}, please",
    ),
    "ip": ("the host at {} did not answer", "ping {} twice", "from ip {} in two hops", "login from {} failed", "the router has {} for years"),
    "card": ("card {} was refused", "pay with card {} today", "number {} on file", "visa {} expired", "he gave his card, {}, at the desk"),
}
PLAIN = (
    "the river rose and the town slept under the hill",
    "in 1998 and again in 2003 the price was 12.50 or 3,400 in all",
    "version 2.4.1 of 2021-03-04 fixes 17 faults, see page 212",
    "at the end of the day, the dot at the top of the page is red",
    "meet at noon at the gate, and at six at the port",
    "order 555 came on 12-10-2020 at 10:45 for room 1204",
    "key = \"a81f\" and password=7d20e14bb9 and token 0f3e99ab12c4d5 are secrets",
    "chapter 3.2.1.4 of part 12 says 1,000,000 of 7,500,000",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "der fluss stieg, und die stadt schlief. la ville dort; el pueblo duerme!",
    "=== --- *** ### ||| <b> </b> {} [] () $$$ %%% && @@ ++",
    "http://www.example.com/en/12?page=2 and https://example.org/a/b.html",
    "he said: \"well, it's fine\" (and left) - or so they say...",
    "copyright (c) 2019 the authors, licensed under version 2.0",
    "isbn 978-3-16-148410-0 and 12 eggs for 99 cents",
    "id 20210304123456789012 and hash 9f86d081884c7d659a2feaa0c55ad015",
    "the the the of of and and in in it was is on for with that are as at be by",
    "end.start of.the foo.bar one.two.three what?yes no!no a.b.c. etc., i.e. u.s.a. e.g. x.y",
    "sections 3.2.1 and 3.2.1.4 and 4.10.2.1 of the code, lines 12 to 40, table 7.3",
    "gr\u00fc\u00dfe \u00e9t\u00e9 ni\u00f1o l'eau d'or c'est self-made well-known e-mail x-ray",
    "Anfang Ende Stadt Haus, Baum; Weg: Tal! Berg? Wald.",
    "call it a day at the port, reach the dot on the card, phone or mail or ring at will",
    "she put the number 12 on the card and the card at the host",
    "at at at at at at at at",
    "dot dot at at dot dot dot at dot",
    "He sat at at noon. At. At At At At the the at at the port",
    "record 7301945528163347 and record 5520918374650021 of the ledger",
    "batch 6630193847561029 9910283746550112 was read",
)


def labelled_lines(turn: int = 0) -> list[str]:
    """Every form of every kind once for each of two lines that carry it, plain lines, and words with marks about them.

    Another `turn` pairs the forms with other names, hosts and lines.
    """
    lines = []
    forms = {"email": EMAIL_FORMS * 2, "phone": PHONE_FORMS, "ip": IP_FORMS, "card": CARD_FORMS}
    for kind, carriers in CARRIERS.items():
        for i, form in enumerate(forms[kind] * 2):
            host = HOSTS[(i + 2 * turn) % len(HOSTS)]
            value = form.format(n=NAMES[(i + 3 * turn) % len(NAMES)], h=host, w=host.replace(".", " dot "), d=host.replace(".", "(dot)")) if kind == "email" else form
            lines.append(carriers[(i + i // len(forms[kind]) + turn) % len(carriers)].replace("{}", f"[{kind}:{value}]"))
    for i, mark in enumerate("*#%&$~_+=|<>()[]{}^@"):
        a, b, c = "of the end at dot red it with Town are then stone".split()[i % 4 :: 4][:3]
        lines.append(f"{a}{mark} {mark}{b} {c}{3 * mark} {a}.{mark} {mark}{b}{mark}, {3 * mark}{c} {a}{mark}{b}")
    for i, mark in enumerate(".,;:!?\"'"):
        words = "and at the of dot in at call it is at red dot the".split()[i % 5 :]
        lines.append(" ".join(w + mark * (1 + (i + j) % 2) for j, w in enumerate(words)))
        lines.append(" ".join(w.upper() + 2 * mark for w in words[1:]))
    for i in range(8):
        digest = hashlib.sha1(str(i + 100 * turn).encode()).hexdigest()[: 12 + 4 * i]
        lines.append(("the key = \"{}\" was set", "token={} and more", "hash {} of the file", "commit {}, then merge")[i % 4].replace("{}", digest))
    return [*lines, *PLAIN]


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # where a run of digits fails from its first, it fails from all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain; a match begins where the run of local characters before its @ begins."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return found


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, kinds in order, then by start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and _luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return found


CUES = {"call", "tel", "phone", "fax", "ring", "mail", "email", "contact", "card", "visa", "host", "ip", "ping", "reach", "dot", "at", "number"}
_TRIM = ".,;:!?\"'"


class _Signs(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = sign = "x" if c.isalpha() else "9" if c.isdecimal() else c if c in "@.+-()[]:/,='" else "#"
        return sign


_SIGNS, _RUN = _Signs(), re.compile(r"(.)\1+", re.DOTALL)
_AT, _DOT = re.compile(r"[(\[{<]at[)\]}>]"), re.compile(r"[(\[{<](?:dot|\.)[)\]}>]")


def shape(token: str) -> str:
    """Letters as x and digits as 9, runs as one, without marks at the ends, of the whole token; letters alone are x."""
    core = token.strip(_TRIM)
    if core.isalpha():
        return "x"
    return _RUN.sub(r"\1", core.translate(_SIGNS))


def _digits(token: str) -> str:
    n = sum(c.isdecimal() for c in token)
    return str(n) if n < 5 else "5-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-19" if n < 20 else "20-"


def token_features(token: str) -> tuple[list[str], str]:
    """Its own features, and what its neighbours see of it."""
    s, low = shape(token), token.strip(_TRIM).lower()
    seen = low if low in CUES else s if len(s) < 6 else "long"
    return ["bias", f"s={s}", f"n={_digits(token)}", f"w={seen}", f"@={'@' in token}", f"at={bool(_AT.search(low))}", f"dot={bool(_DOT.search(low))}", f"mix={'x' in s and '9' in s}", f"mark={token[-1:] in _TRIM and token != ''}"], seen


class Model:
    """Weights: own[feature][tag], seen before and after [feature][tag], and tag to tag (row 0 and column 0 also border)."""

    def __init__(self, features: dict[str, int], seen: dict[str, int], own, before, after, moves):
        self.features, self.seen = features, seen
        self.own, self.before, self.after, self.moves = own, before, after, moves

    def tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: own emission, and what it adds to the word after it and before it."""
        own = np.zeros((len(words), len(TAGS)))
        near = np.zeros(len(words), np.int64)
        unknown = len(self.seen)
        for i, w in enumerate(words):
            feats, s = token_features(w)
            own[i] = self.own[[self.features[f] for f in feats if f in self.features]].sum(axis=0)
            near[i] = self.seen.get(s, unknown)
        pad = np.zeros((1, len(TAGS)))
        return own, np.vstack((self.before, pad))[near], np.vstack((self.after, pad))[near]


def _parsed(line: str) -> tuple[list[str], list[int]]:
    """Tokens and tags of a labelled line."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone):((?:\[at\]|\[\.\]|[^\]])*)\]", line):
        text += line[at : m.start()]
        spans.append((KINDS.index(m[1]), len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    text += line[at:]
    tokens, tags = [], []
    for m in re.finditer(r"\S+", text):
        tokens.append(m[0])
        kind = next(((k, a) for k, a, b in spans if a < m.end() and m.start() < b), None)
        tags.append(0 if kind is None else 1 + 2 * kind[0] + (m.start() > kind[1]))
    return tokens, tags


def train(lines: list[str] | None = None, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Penalised maximum likelihood over all lines together."""
    parsed = [_parsed(line) for line in lines or labelled_lines()]
    features: dict[str, int] = {}
    seen: dict[str, int] = {}
    for tokens, _ in parsed:
        for t in tokens:
            fs, s = token_features(t)
            for f in fs:
                features.setdefault(f, len(features))
            seen.setdefault(s, len(seen))
    n, longest, k = len(parsed), max(len(t) for t, _ in parsed), len(TAGS)
    hot = np.zeros((n, longest, len(features)))
    near = np.zeros((n, longest, len(seen)))
    gold = np.zeros((n, longest, k))
    length = np.array([len(t) for t, _ in parsed])
    for i, (tokens, tags) in enumerate(parsed):
        for j, (t, g) in enumerate(zip(tokens, tags, strict=True)):
            fs, s = token_features(t)
            hot[i, j, [features[f] for f in fs]] = 1
            near[i, j, seen[s]] = 1
            gold[i, j, g] = 1
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[:, 1:], after[:, :-1] = near[:, :-1], near[:, 1:]
    inputs = np.concatenate((hot, before, after), axis=2)
    weights, moves = np.zeros((inputs.shape[2], k)), np.zeros((k, k))
    live = np.arange(longest)[None, :] < length[:, None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    gold_moves[0] += gold[:, 0].sum(axis=0)
    gold_moves[:, 0] += gold[np.arange(n), length - 1].sum(axis=0)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, steps + 1):
        e = inputs @ weights
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, longest):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + moves[None], 1) + e[:, t]
        for t in range(longest - 1, -1, -1):
            last = (length - 1 == t)[:, None]
            onward = lse(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < longest else np.zeros((n, k))
            beta[:, t] = np.where(last, moves[:, 0][None], onward)
        logz = lse(alpha[:, 0] + beta[:, 0], 1)
        post = np.exp(np.minimum(alpha + beta - logz[:, None, None], 0)) * live[:, :, None]
        pairs = alpha[:, :-1, :, None] + moves[None, None] + (e + beta)[:, 1:, None, :] - logz[:, None, None, None]
        expected = (np.exp(np.minimum(pairs, 0)) * live[:, 1:, None, None]).sum(axis=(0, 1))
        expected[0] += post[:, 0].sum(axis=0)
        expected[:, 0] += post[np.arange(n), length - 1].sum(axis=0)
        gw = np.einsum("ntf,ntk->fk", inputs, gold - post) / n - penalty * weights
        gm = (gold_moves - expected) / n - penalty * moves
        for x, g, m, v in ((weights, gw, *moments[:2]), (moves, gm, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f, s = len(features), len(seen)
    return Model(features, seen, weights[:f], weights[f : f + s], weights[f + s :], moves)


def viterbi(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of stretches of emissions `e`, all together; O stands before and after each."""
    tags = np.zeros(len(e), np.int64)
    if not len(starts):
        return tags
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    score = e[starts] + moves[0]
    back = []
    for t in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        options = score[:live, :, None] + moves[None]
        came = options.argmax(axis=1)
        back.append(came)
        score[:live] = np.take_along_axis(options, came[:, None], 1)[:, 0] + e[starts[:live] + t]
    best = (score + moves[:, 0]).argmax(axis=1)
    tags[starts + sizes - 1] = best
    for t in range(int(sizes[0]) - 1, 0, -1):
        live = len(back[t - 1])
        best[:live] = np.take_along_axis(back[t - 1], best[:live, None], 1)[:, 0]
        tags[starts[:live] + t - 1] = best[:live]
    return tags


class Tagger:
    """Tags blocks of texts. What distinct tokens emit is kept while the block lasts."""

    def __init__(self, model: Model):
        self.model = model
        m = model.moves
        # most that the moves around a token can speak for a tag against O
        self.moves_gain = np.array([(m[:, k][:, None] + m[k][None, :] - m[:, 0][:, None] - m[0][None, :]).max() for k in range(len(TAGS))])
        self.near_gain = sum(np.maximum((t - t[:, :1]).max(axis=0), 0) for t in (model.before, model.after))

    def tags(self, texts: list[str]) -> list[np.ndarray | None]:
        """Tags of every token of each text, None where all are O."""
        index = Numbered()
        ids = [np.fromiter(map(index.__getitem__, t.split()), np.int64) for t in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not index:
            return out
        plain = np.fromiter((w.isalpha() or w[:-1].isalpha() and w[-1] in _TRIM for w in index), bool, len(index))
        words = list(index)
        # words of letters with at most one mark behind them share few emissions: one for each cue and mark
        same: dict = {}
        kept: list[str] = []
        of = np.empty(len(words), np.int64)
        for i, (w, p) in enumerate(zip(words, plain.tolist(), strict=True)):
            key = ((w if w.isalpha() else w[:-1]).lower(), w[-1] in _TRIM) if p else w
            if p and key[0] not in CUES:
                key = ("", key[1])
            if key not in same:
                same[key] = len(kept)
                kept.append(w)
            of[i] = same[key]
        own, before, after = self.model.tables(kept)
        sure_kind = ((own[:, :1] - own)[:, 1:] > (self.moves_gain + self.near_gain)[None, 1:]).all(axis=1)
        flat = of[np.concatenate(ids)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        open_ = ~sure_kind[flat]
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        e = own[flat[at]]
        has = (at > 0) & (doc[at] == doc[np.maximum(at - 1, 0)])
        e[has] += before[flat[at[has] - 1]]
        has = (at + 1 < len(flat)) & (doc[at] == doc[np.minimum(at + 1, len(flat) - 1)])
        e[has] += after[flat[at[has] + 1]]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]))
        starts = np.flatnonzero(new)
        tags = viterbi(e, starts, np.diff(np.append(starts, len(at))), self.model.moves)
        first = np.cumsum(sizes) - sizes
        for d in np.unique(doc[at[tags > 0]]).tolist():
            own_tags = np.zeros(int(sizes[d]), np.int64)
            mine = doc[at] == d if len(texts) < 2 else slice(*np.searchsorted(doc[at], [d, d + 1]))
            own_tags[at[mine] - first[d]] = tags[mine]
            out[d] = own_tags
        return out


def tagged_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of runs of one kind; marks at their ends are left out."""
    found, open_kind, span = [], None, (0, 0)
    for m, tag in zip(re.finditer(r"\S+", text), tags.tolist(), strict=True):
        kind = None if tag == 0 else (tag - 1) // 2
        if kind is None or kind != open_kind or tag % 2 == 1:
            if open_kind is not None:
                found.append((open_kind, *span))
            span = m.span()
        else:
            span = (span[0], m.end())
        open_kind = kind
    if open_kind is not None:
        found.append((open_kind, *span))
    out = []
    for kind, a, b in found:
        core = text[a:b]
        a += len(core) - len(core.lstrip(_TRIM))
        b -= len(core) - len(core.rstrip(_TRIM))
        if a < b:
            out.append((kind, a, b))
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """For each text its plain spans, and those with what the CRF adds."""
    out = []
    for text, tags in zip(texts, tagger.tags(texts), strict=True):
        plain = plain_spans(text)
        added = [] if tags is None else [s for s in tagged_spans(text, tags) if not any(s[1] < b and a < s[2] for _, a, b in plain)]
        out.append((plain, sorted(plain + added)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model | None = None, texts: bool = True) -> DataFrame:
    """`docs` with counts of the plain spans by kind, base_sha256, spans and redacted (the text without them; null for null).

    texts=False leaves out text and redacted, so that no text returns from Python.
    """
    added = T.StructType(
        [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), *(T.StructField(k, T.StringType()) for k in ("base_sha256", "spans", "redacted"))]
    )
    docs = docs.drop(*added.names)
    left_out = () if texts else ("text", "redacted")
    schema = T.StructType([f for f in (*docs.schema.fields, *added.fields) if f.name not in left_out])
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for block in blocks(batches, "text", BLOCK_BYTES):
            raw = block.column(block.schema.get_field_index("text")).to_pylist()
            rows = []
            for t, (plain, every) in zip(raw, all_spans([t or "" for t in raw], tagger), strict=True):
                counts = np.bincount([k for k, _, _ in plain], minlength=4).tolist() if plain else [0, 0, 0, 0]
                rows.append((*counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every), t if not every or not texts else redacted(t, every)))
            columns = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
            named = zip([*block.columns, *columns], [*block.schema.names, *added.names], strict=True)
            kept = [(c, n) for c, n in named if n not in left_out]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept], [n for _, n in kept])

    return small_batches(docs).mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
