"""Secret scans: base patterns, and a linear-chain conditional random field over the words of each text.

The field tags every word as secret begin, inside or outside from its shape, the neighbouring words and features of its file
(document), decoded by Viterbi. It is trained here, by gradient ascent on the log-likelihood, on generated lines whose secrets
are known by construction: forms that the base patterns miss (spoken hints, command-line options, headers, addresses with
credentials, prefixed keys, marks other than : and =) among filler words taken from the corpus, with lines that look alike
but hold none. Plain lines of the corpus join as lines without secrets; lines in which a base pattern matches, or that might hold another
secret (a telling word, or letters and digits mixed in a long word that is no address), take no part, so the field is taught neither the patterns nor mistakes. The sample of the corpus (at most `sample_docs` documents, those of least id hash, of
`sample_chars` characters at most) bounds what reaches the driver; every text is scanned whole.

Decoding is exact but cheap: a word whose score for outside leads by more than twice the range of the
transitions is outside on the best path, whatever stands next to it, so texts are cut there and only the few
stretches between are decoded, in padded matrices by length.

Defined results: null text counts as empty; doc_id, null or repeated, is carried through; an empty table gives no rows
(and trains on the generated lines alone); only doc_id and text are read, and columns of any other name are carried through.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, least_ids, slices, small_batches, tidy

#: Fixed values of the contract: the base patterns; all their characters are ASCII, so they are matched on bytes.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_KEYWORDS = (*_ASSIGN_WORDS[:4], b"apikey", b"api_key", b"api-key", b"pwd", b"credential", b"bearer", b"private_key")

O, B, I = range(3)
#: Buckets of a word's own features: length, share of digits, case, switches between letters and digits, then flags.
_OWN = (6, 4, 5, 3, 2, 2, 2, 2, 2)
_NEAR = 8  # flags of neighbours and of the file
#: Places whose word, by the hash of its letters and digits, is a feature: the word before, the one before that, the one after.
_PLACES, _WORDS = (-1, -2, 1), 1 << 12
_MARK = b"[SECRET]"


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_DIGIT, _UPPER, _LOWER = (_lut(x.encode()) for x in (string.digits, string.ascii_uppercase, string.ascii_lowercase))
_LETTERS = _DIGIT | _UPPER | _LOWER | (np.arange(256) > 127)
_HEX, _JOINT, _INNER, _QUOTE = _lut(b"0123456789abcdef"), _lut(b"=:"), _lut(b"_+/-.@"), _lut(b"\"'`")


def base_spans(w: Words) -> list[tuple[int, int, int, int]]:
    """(text, kind, first byte, end byte), bytes within the text."""
    out, offsets = [], w.offsets
    data = w.data
    hexes = _HEX[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(hexes & (edge[:-1] | ~np.r_[False, hexes[:-1]]))
    end = np.flatnonzero(hexes & (edge[1:] | ~np.r_[hexes[1:], False])) + 1
    long = end - start >= 24
    of = np.searchsorted(offsets, start[long], side="right") - 1
    out += [(int(t), 2, int(a - offsets[t]), int(b - offsets[t])) for t, a, b in zip(of, start[long], end[long])]
    raw = data.tobytes()
    low = raw.lower()
    texts: set[int] = set()
    for word in _ASSIGN_WORDS:
        texts.update((np.searchsorted(offsets, _places(low, word), side="right") - 1).tolist())
    for t in texts:
        out += [(t, 0, m.start(), m.end()) for m in ASSIGN.finditer(raw[offsets[t] : offsets[t + 1]]) if len(m[2]) >= 6]
    for t in set((np.searchsorted(offsets, _places(raw, b"AKIA"), side="right") - 1).tolist()):
        out += [(t, 1, m.start(), m.end()) for m in ACCESS.finditer(raw[offsets[t] : offsets[t + 1]]) if m.end() - m.start() >= 20]
    return sorted(out, key=lambda x: (x[0], x[2], x[1], x[3]))


def _places(data: bytes, word: bytes) -> np.ndarray:
    found, at = [], data.find(word)
    while at >= 0:
        found.append(at)
        at = data.find(word, at + 1)
    return np.array(found, np.int64)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flags, dtype=np.int64)]


def word_codes(w: Words) -> np.ndarray:
    """Of each word: the bucket of its letters and digits, lower-cased, without the other characters around them; 0 where there are none."""
    solid = np.flatnonzero(_LETTERS[w.data])
    if not len(solid):
        return np.zeros(len(w.start), np.int64)
    i, j = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end) - 1
    some = j >= i
    a, b = solid[np.minimum(i, len(solid) - 1)], solid[np.maximum(j, 0)] + 1
    return np.where(some, 1 + (w.spans(np.where(some, a, 0), np.where(some, b, 0), lower=True) % np.uint64(_WORDS - 1)).astype(np.int64), 0)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the code of its own features, the flags of its neighbours and its file as bits, and the codes of neighbouring words."""
    data, s, e, n = w.data, w.start, w.end, len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_PLACES)), np.int64)
    size = e - s
    digit, upper, lower = _DIGIT[data], _UPPER[data], _LOWER[data]
    digits, uppers, lowers = (x[e] - x[s] for x in map(_sums, (digit, upper, lower)))
    letter = upper | lower
    switch = np.zeros(len(data), bool)
    switch[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    switches = _sums(switch)
    switches = switches[e] - switches[s]
    joint, inner, quote, wide = (x[e] - x[s] > 0 for x in map(_sums, (_JOINT[data], _INNER[data], _QUOTE[data], data > 127)))
    length = np.searchsorted([5, 8, 16, 24, 40], size, side="right")
    share = np.where(digits == 0, 0, np.searchsorted([0.15, 0.4], digits / size, side="right") + 1)
    case = np.select([uppers + lowers == 0, uppers == 0, lowers == 0, (uppers == 1) & upper[s]], [0, 1, 2, 3], 4)
    key = np.zeros(n, bool)
    low = data.tobytes().lower()
    for word in _KEYWORDS:
        at = np.searchsorted(s, _places(low, word), side="right") - 1
        key[at[at >= 0]] = True
    own = np.zeros(n, np.int64)
    for size_of, value in zip(_OWN, (length, share, case, np.searchsorted([1, 3], switches, side="right"), joint, inner, quote, wide, key)):
        own = own * size_of + value
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = w.count > 0
    first[w.first[:-1][some]] = True
    last[w.first[1:][some] - 1] = True
    before = lambda x: np.where(first, False, np.r_[False, x[:-1]])
    after = lambda x: np.where(last, False, np.r_[x[1:], False])
    ends_joint = _JOINT[data[e - 1]]
    odd = (size >= 12) & (digits > 0) & (uppers + lowers > 0)
    of = w.text
    has_key = np.bincount(of[key], minlength=len(w.count)) > 0
    dense = np.bincount(of, weights=digits, minlength=len(w.count)) > 0.05 * np.bincount(of, weights=size, minlength=len(w.count))
    two = before(before(key))
    near = np.zeros(n, np.int64)
    for flag in (before(key), before(ends_joint), two, before(before(ends_joint)), after(ends_joint), after(odd), has_key[of], dense[of]):
        near = near * 2 + flag
    code, at, beside = word_codes(w), np.arange(n), np.zeros((n, len(_PLACES)), np.int64)
    for k, step in enumerate(_PLACES):
        j = at + step
        ok = (j >= w.first[:-1][of]) & (j < w.first[1:][of])
        beside[ok, k] = code[j[ok]]
    return own, near, beside


class Field:
    """Weights: score tables of own codes and of neighbour flags by tag, and transitions (from, to)."""

    def __init__(self):
        self.groups = [np.zeros((k, 3)) for k in _OWN]
        self.flags = np.zeros((_NEAR, 3))
        self.words = np.zeros((len(_PLACES), _WORDS, 3))
        self.bias = np.zeros(3)
        self.trans = np.zeros((3, 3))

    @staticmethod
    def unpack(own: np.ndarray, near: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        parts = []
        for k in reversed(_OWN):
            parts.append(own % k)
            own = own // k
        return parts[::-1], (near[:, None] >> np.arange(_NEAR - 1, -1, -1)) & 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        parts, bits = self.unpack(np.arange(np.prod(_OWN)), np.arange(1 << _NEAR))
        return self.bias + sum(g[p] for g, p in zip(self.groups, parts)), bits @ self.flags

    def fit(self, own, near, beside, tags, mask, rounds: int = 80, rate: float = 0.2, decay: float = 1e-4) -> Field:
        """Gradient ascent (Adam) on the mean log-likelihood of padded sequences (rows by positions); forward and
        backward sums are kept as probabilities, scaled at each position."""
        rows, width = own.shape
        parts, bits = self.unpack(own.ravel(), near.ravel())
        hot = np.concatenate([np.eye(k)[p] for k, p in zip(_OWN, parts)] + [bits, np.ones((rows * width, 1))], 1).astype(np.float32)
        gold = np.eye(3)[tags] * mask[..., None]
        gold_trans = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
        on = mask[..., None] > 0
        weights = np.zeros((hot.shape[1], 3))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, self.trans, self.words)]
        beside = beside.reshape(-1, len(_PLACES)).T
        for step in range(1, rounds + 1):
            score = hot @ weights.astype(np.float32) + sum(words[code] for words, code in zip(self.words, beside))
            score = np.exp(score.astype(float)).reshape(rows, width, 3)
            ways = np.exp(self.trans)
            alpha, beta = np.empty((rows, width, 3)), np.ones((rows, width, 3))
            alpha[:, 0] = score[:, 0] / score[:, 0].sum(1, keepdims=True)
            for t in range(1, width):
                x = (alpha[:, t - 1] @ ways) * score[:, t]
                alpha[:, t] = np.where(on[:, t], x / x.sum(1, keepdims=True), alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                x = (score[:, t + 1] * beta[:, t + 1]) @ ways.T
                beta[:, t] = np.where(on[:, t + 1], x / x.sum(1, keepdims=True), 1.0)
            one = alpha * beta
            off = gold - one / one.sum(2, keepdims=True) * mask[..., None]
            two = alpha[:, :-1, :, None] * ways * (score * beta)[:, 1:, None, :]
            two = (two / two.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]).sum((0, 1))
            flat = off.reshape(-1, 3)
            words = np.stack([np.stack([np.bincount(code, weights=flat[:, k], minlength=_WORDS) for k in range(3)], 1) for code in beside])
            for p, g, (m, v) in zip((weights, self.trans, self.words), (hot.T @ flat.astype(np.float32), gold_trans - two, words), moments):
                g = g / rows - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        cuts = np.cumsum([0, *_OWN, _NEAR])
        self.groups = [weights[i:j] for i, j in zip(cuts, cuts[1:-1])]
        self.flags, self.bias = weights[cuts[-2] : cuts[-1]], weights[-1]
        return self

    def decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of all words; first marks the words where a text starts."""
        n, tags = len(score), np.zeros(len(score), np.int8)
        lead = score[:, O] - np.maximum(score[:, B], score[:, I])
        open_ = lead <= 2 * (self.trans.max() - self.trans.min())
        if not open_.any():
            return tags
        start = np.flatnonzero(open_ & (first | ~np.r_[False, open_[:-1]]))
        end = np.flatnonzero(open_ & np.r_[first[1:] | ~open_[1:], True]) + 1
        size = end - start
        # a neighbour that is surely outside takes part in the transitions at both ends
        led, follows = ~first[start], np.r_[~first, False][end]
        width = 1
        while width < 2 * size.max():
            at = np.flatnonzero((size <= width) & (size > width // 2))
            for part in np.array_split(at, len(at) * width // 1_000_000 + 1):
                if len(part):
                    self._viterbi(score, start[part], size[part], led[part], follows[part], width, tags)
            width *= 2
        return tags

    def _viterbi(self, score, start, size, led, follows, width, tags) -> None:
        where = np.minimum(start[:, None] + np.arange(width), len(score) - 1)
        best = score[where[:, 0]] + np.where(led[:, None], self.trans[O], 0)
        came = np.zeros((len(start), width, 3), np.int8)
        came[:, 0] = np.arange(3)
        for t in range(1, width):
            ways = best[:, :, None] + self.trans
            on = (t < size)[:, None]
            came[:, t] = np.where(on, ways.argmax(1), np.arange(3))
            best = np.where(on, ways.max(1) + score[where[:, t]], best)
        tag = (best + np.where(follows[:, None], self.trans[:, O], 0)).argmax(1)
        row = np.arange(len(start))
        for t in range(width - 1, -1, -1):
            on = t < size
            tags[where[on, t]] = tag[on]
            tag = came[row, t, tag]


#: Forms of lines with a secret for training, and others that only tests use. {v} is the secret, {k} a random key of letters and digits, {u} a name.
FORMS = (
    "the password is {v}", "password for {u} is {v}", "my passphrase is {v}", "log in as {u} with {v}", "passcode {v}", "pin code {v}", "credentials: {u} / {v}", "user {u} pass {v}",
    "--password {v}", "--token {v}", "-p {v}", "mysql -u {u} -p{v}", "export DB_PASS {v}", "pwd: {v}", "pwd={v}", "pass = {v}", "credential: {v}", "private_key: {v}", "client key {v}",
    "Authorization: Bearer {v}", "Authorization: Basic {v}", "Bearer {v}", "X-Auth: {v}", "Cookie: session={v}", "postgres://{u}:{v}@db.{u}.net/main", "https://{u}:{v}@git.{u}.org/{u}.git",
    "ghp_{k}", "sk_live_{k}", "xoxb-{k}", "key-{k}", "eyJ{k}.{k}.{k}", "ssh-rsa AAAAB3{k}{k}", "signing key {v}", "secret -> {v}", "password => {v}", "shared secret {v}",
)
#: Lines that look alike and hold none.
PLAIN_FORMS = (
    "the password is wrong", "the password is required", "password for {u} was reset", "forgot your password ?", "a token of {u}", "the secret of {u}", "Bearer of the ring", "--verbose {u}",
    "-p 8080", "{n}", "{d}", "{u}@{u}.com", "{u}.{n}@{u}{n}.{u}.com", "{u}{n}@{u}.org", "{u}_{u}@{u}{n}.net", "http://{u}.com/{u}/{n}", "+{n} {n}", "{n}.{n}.{n}.{n}", "v{n}.{n}", "order {n}", "isbn {n}-{n}-{n}", "key {u}", "pass the {u}", "user {u}", "log in as {u}",
    "authorization {u}", "commit message", "###{u}", "{u}: {u}", "room {n}b", "model {U}{n}", "session {u}", "export {u}", "client {u}", "credentials of {u}", "pin {u}", "{d} {n}:{n}",
)
TEST_FORMS = (
    "passwort lautet {v}", "unlock with {v}", "--api-token {v}", "the new password will be {v}", "Proxy-Authorization: Bearer {v}", "amqp://{u}:{v}@queue.{u}.io", "glpat-{k}", "pk_live_{k}",
    "db password -> {v}", "wifi passphrase : {v}", "use token {v}", "login {u} password {v}", "set secret {v}", "SESSION_KEY {v}",
)


def generated_lines(forms: tuple[str, ...] = FORMS, seed: int = 7, n: int = 2000, filler: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the character spans of secrets, from a fixed generator: every second one holds a secret in one of the forms, among filler words."""
    r = random.Random(seed)
    made = lambda: "".join(r.choice(("th", "er", "on", "an", "in", "de", "que", "sch", "ó", "é", "ti", "la", "um")) for _ in range(r.randint(1, 4)))
    plain = lambda: r.choice(filler) if filler and r.random() < 0.7 else made() + r.choice(("", "", "", ".", ","))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    mixed = string.ascii_letters + string.digits
    values = (
        lambda: pick(mixed, r.randint(8, 40)), lambda: pick(mixed + "!#$%&*+-_@?", r.randint(8, 24)), lambda: pick(string.ascii_lowercase + string.digits, r.randint(8, 32)),
        lambda: pick("0123456789ABCDEF", r.choice((16, 32, 40))), lambda: made() + made() + pick(string.digits, 3) + r.choice("!?#$"), lambda: pick(mixed + "+/", r.randint(20, 43)) + "=",
        lambda: "-".join(pick(mixed, 5) for _ in range(4)),
    )
    out = []
    for k in range(n):
        line, spans = " ".join(plain() for _ in range(r.randint(0, 12))), []
        parts = [r.choice(PLAIN_FORMS) for _ in range(r.randint(0, 2))] + ([r.choice(forms)] if k % 2 else [])
        for part in parts:
            line += " " * bool(line)
            start = len(line)
            value = None
            for x in re.split(r"(\{\w\})", part):
                if x == "{v}":
                    value = r.choice(values)()
                    x = r.choice((value, value, value, f'"{value}"'))
                elif x == "{k}":
                    x = pick(mixed, r.randint(16, 36))
                    value = part
                else:
                    x = {"{u}": made, "{U}": lambda: made().upper(), "{n}": lambda: str(r.randint(1, 99999)), "{d}": lambda: f"20{r.randint(10, 29)}-{r.randint(1, 12)}-{r.randint(1, 28)}"}.get(x, lambda: x)()  # noqa: B023
                line += x
            if value is not None:
                # the secret is the last word of its form
                spans.append((max(start, line.rfind(" ") + 1), len(line)))
        line += "".join(" " + plain() for _ in range(r.randint(0, 10)))
        out.append((line, spans))
    return out


def labelled(lines: list[str], spans: list[list[tuple[int, int]]]) -> tuple[Words, np.ndarray]:
    """The words of lines and their tags; spans are in bytes of their line."""
    w = Words(pa.array(lines, pa.string()))
    tag = np.zeros(len(w.start), np.int64)
    for k, found in enumerate(spans):
        lo, hi = w.first[k], w.first[k + 1]
        s, e = w.start[lo:hi] - w.offsets[k], w.end[lo:hi] - w.offsets[k]
        for a, b in found:
            at = lo + np.flatnonzero((s < b) & (e > a))
            tag[at] = I
            tag[at[:1]] = B
    return w, tag


def in_bytes(line: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(len(line[:a].encode()), len(line[:b].encode())) for a, b in spans]


_DOUBTFUL = re.compile(r"(?i:pass|pwd|secret|token|key|bearer|auth|credential)|(?<!\S)(?=\S*[0-9])(?=\S*[A-Za-z])[^\s@]{10,}(?!\S)")


def train(samples: list[str], width: int = 24, most_lines: int = 1500) -> Field:
    """A field fitted to generated lines, with words of the sample texts as filler, and to sample lines in which no base pattern matches."""
    rows = [x for text in samples for x in text.split("\n") if x.strip()]
    hit = {t for t, *_ in base_spans(Words(pa.array(rows, pa.string())))}
    clean = [x for k, x in enumerate(rows) if k not in hit and not _DOUBTFUL.search(x)]
    clean = clean[:: max(1, len(clean) // most_lines)]
    made = generated_lines(filler=tuple(x for line in clean[:500] for x in line.split()[:40]))
    w, tag = labelled([x for x, _ in made] + clean, [in_bytes(*x) for x in made] + [[]] * len(clean))
    own, near, beside = features(w)
    # sequences of at most `width` words; in longer lines the stretch around a secret, else the start
    begin = [max(0, int(np.argmax(tag[lo:hi] > 0)) - width // 2) if hi - lo > width else 0 for lo, hi in zip(w.first, w.first[1:])]
    first = w.first[:-1] + np.array(begin)
    size = np.minimum(width, w.first[1:] - first)
    first, size = first[size > 0], size[size > 0]
    at = np.minimum(first[:, None] + np.arange(width), len(own) - 1)
    mask = (np.arange(width) < size[:, None]).astype(float)
    return Field().fit(own[at], near[at], beside[at], tag[at], mask)


def sample_texts(docs: DataFrame, sample_docs: int = 1000, sample_chars: int = 20_000) -> list[str]:
    """Training texts: of the sample_docs documents of least id hash those of at most sample_chars characters; of repeated ids one text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(least_ids(docs, sample_docs)), "doc_id", "left_semi")
    return sorted(r.text for r in rows.where(F.length("text") <= sample_chars).groupBy("doc_id").agg(F.min("text").alias("text")).collect())


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def uncovered(a: int, b: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The stretches of a to b outside disjoint ones."""
    out = []
    for k in range(bisect.bisect_right(ends, a), len(starts)):
        if starts[k] >= b:
            break
        if a < starts[k]:
            out.append((a, starts[k]))
        a = ends[k]
    return [*out, (a, b)] if a < b else out


#: Whole words that no secret is, whatever stands beside them: mail addresses and plain numbers, with marks around them.
_NO_SECRET = re.compile(rb"[\"'(<\[]*(?:(?:mailto:)?[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|[+#]?[0-9](?:[0-9.,:/()-]*[0-9])?%?)[\"')>\].,;:!?]*")


class Scanner:
    def __init__(self, field: Field):
        self.field = field
        self.own, self.near = field.tables()

    def tags(self, w: Words) -> np.ndarray:
        own, near, beside = features(w)
        first = np.zeros(len(own), bool)
        first[w.first[:-1][w.count > 0]] = True
        return self.field.decode(self.own[own] + self.near[near] + sum(words[code] for words, code in zip(self.field.words, beside.T)), first)

    def spans(self, w: Words) -> list[list[tuple[int, int, int]]]:
        """Of each text, (kind, start, end) in code points, in order; what the field adds is clipped, so that it overlaps no base span."""
        found = base_spans(w)
        if len(w.start):
            tags = self.tags(w)
            first = np.zeros(len(tags), bool)
            first[w.first[:-1][w.count > 0]] = True
            begin = np.flatnonzero((tags > 0) & ((tags == B) | first | (np.r_[0, tags[:-1]] == 0)))
            if len(begin):
                stops = np.flatnonzero(np.r_[(tags[1:] != I) | first[1:], True]) + 1
                end = stops[np.searchsorted(stops, begin, side="right")]
                text = w.text
                taken: dict[int, list[tuple[int, int]]] = {}
                for t, _, a, b in found:
                    taken.setdefault(t, []).append((a, b))
                covered = {t: disjoint(x) for t, x in taken.items()}
                for i, j in zip(begin, end):
                    t = int(text[i])
                    a, b = int(w.start[i] - w.offsets[t]), int(w.end[j - 1] - w.offsets[t])
                    if all(_NO_SECRET.fullmatch(w.data[w.start[k] : w.end[k]].tobytes()) for k in range(i, j)):
                        continue
                    # what a base span leaves counts only where it isn't mere punctuation
                    for x, y in uncovered(a, b, *covered.get(t, ([], []))):
                        if _LETTERS[w.data[w.offsets[t] + x : w.offsets[t] + y]].any():
                            found.append((t, 3, x, y))
        out: list[list[tuple[int, int, int]]] = [[] for _ in w.count]
        if found:
            points = _sums((w.data & 0xC0) != 0x80)
            for t, kind, a, b in found:
                zero = points[w.offsets[t]]
                out[t].append((kind, int(points[w.offsets[t] + a] - zero), int(points[w.offsets[t] + b] - zero)))
        return [sorted(x, key=lambda y: (y[1], y[0], y[2])) for x in out]


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame, **sample) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every text."""
    scanner = Scanner(train(sample_texts(docs, **sample)))
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = scanner.spans(Words(part.column("text")))
                count = lambda kind: pa.array([sum(k == kind for k, _, _ in x) for x in found], pa.int64())  # noqa: B023, E731
                digest = [hashlib.sha256(written_out([y for y in x if y[0] < 3]).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count(0), count(1), count(2), pa.array(digest, pa.string()), pa.array(list(map(written_out, found)), pa.string()), count(3)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover, touching ones together, replaced by a mark."""
    out, at, upto = [], 0, -1
    for _, a, b in spans:
        if a > upto:
            out += [text[at:a], _MARK.decode()]
        upto = max(upto, b)
        at = max(at, upto)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, **sample) -> DataFrame:
    """The documents with their secrets replaced; columns are those of docs (n_chars, where it is there, follows the text)."""
    scanner = Scanner(train(sample_texts(docs, **sample)))
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                found = scanner.spans(Words(part.column(at)))
                texts = part.column(at).to_pylist()
                for k, spans in enumerate(found):
                    if spans:
                        texts[k] = redact(texts[k], spans)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
