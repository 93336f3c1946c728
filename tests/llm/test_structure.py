"""Conversation repair, packing and phrase mining against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from sedimark.llm import packing, phrase_mining, turn_repair
from sedimark.llm.common import text_buffer

CHATS = "conv_id long, turn long, role string, text string, extra string"


# conversations


def damage(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits tried, with whole audits kept: the least (cost, audit, repaired lines) over every way that ends well."""
    kinds, inserts = faults(rows), 3
    legal = re.compile("s?(ua)*u?").fullmatch  # what can still become (s?(ua)+)?
    ways = {"": (0, "", ())}  # by initials so far, shortened to what matters

    def short(initials):
        return initials if len(initials) < 2 else "ua" if initials[-1] == "a" else "uau"

    def better(found, initials, cost, audit, lines):
        key = short(initials)
        if legal(initials) and (key not in found or (cost, audit) < found[key][:2]):
            found[key] = cost, audit, lines

    def inserted(ways):
        found = dict(ways)
        for _ in range(inserts):
            for initials, (cost, audit, lines) in [*found.items()]:
                for role in ("user", "assistant"):
                    better(found, initials + role[0], cost + 3, audit + "I", (*lines, f"{role}:"))
        return found

    for (_, role, text), kind in zip(rows, kinds):
        # insertions stay apart from where the turn starts, as an audit of one more letter may be less than one that goes on
        found = {}
        starts = [ways]
        for _ in range(inserts):
            more = {}
            for initials, (cost, audit, lines) in starts[-1].items():
                for r in ("user", "assistant"):
                    better(more, initials + r[0], cost + 3, audit + "I", (*lines, f"{r}:"))
            starts.append(more)
        for start in starts:
            for initials, (cost, audit, lines) in start.items():
                better(found, initials, cost + 4, audit + "D", lines)
                if kind in ("blank", "duplicate"):
                    continue
                stay = 3 if kind == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    better(found, initials + role[0], cost + stay, audit + "K", (*lines, f"{role}:{text}"))
                for r in ("user", "assistant"):
                    better(found, initials + r[0], cost + 3 + stay, audit + "R", (*lines, f"{r}:{text}"))
        ways = found
    ends = [(c, a, ls) for i, (c, a, ls) in inserted(ways).items() if re.fullmatch("(s?(ua)+)?", i)]
    return min(ends, key=lambda e: e[:2])


def all_edits(rows):
    """Every sequence of edits of a few turns, tried in full."""
    kinds = faults(rows)
    runs = [r for k in range(3) for r in itertools.product("ua", repeat=k)]
    best = None
    choices = [["D"] if k in ("blank", "duplicate") else ["D", "K", "u", "a"] for k in kinds]
    for edits in itertools.product(*choices):
        for ins in itertools.product(runs, repeat=len(rows) + 1):
            initials, audit, cost = "", "", 0
            for k, e in enumerate([*edits, None]):
                initials, audit, cost = initials + "".join(ins[k]), audit + "I" * len(ins[k]), cost + 3 * len(ins[k])
                if e is None:
                    break
                audit += "R" if e in "ua" else e
                cost += 4 if e == "D" else (3 if e in "ua" else 0) + (3 if kinds[k] == "truncated" else 0)
                initials += "" if e == "D" else rows[k][1][:1] if e == "K" else e
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def report(rows):
    by = defaultdict(list)
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        if not own:
            out[conv] = 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
            continue
        count, turns = Counter(faults(own)), {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return out


def chats(seed, n, longest=9):
    r = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", " \t", "Why?\n", "ok .  ", "é。", None, "same."]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            at = None if r.random() < 0.05 else turn * r.choice((1, 1, 2)) - (turn > 5)
            rows.append((conv if conv else None, at, r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None)), r.choice(texts)))
    return rows


def as_dict(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHATS)


def test_whole_audits_are_the_least_of_all_edits():
    r = random.Random(3)
    for _ in range(60):
        rows = [(k, r.choice(("user", "assistant", "system", "tool")), r.choice(("Hi.", "no", "", "Yes!"))) for k in range(r.randint(0, 2))]
        assert cheapest(rows)[:2] == all_edits(rows)
        assert (found := turn_repair.repair(rows))["cost"] == cheapest(rows)[0] and found["audit"] == cheapest(rows)[1]


def test_repair(spark):
    rows = chats(1, 300)
    assert as_dict(turn_repair.repaired(frame(spark, rows))) == report(rows)


def test_repair_in_parts(spark):
    """Conversations that are worked on in ranges come out alike; some of them are one hot key."""
    rows = chats(2, 12, 60) + [(77, k // 3, ("user", "assistant")[k % 2], f"t{k % 50}.") for k in range(600)]
    assert as_dict(turn_repair.repaired(frame(spark, rows), crowd=5, part_bytes=600)) == report(rows)


def test_repaired_turns(spark):
    rows = chats(5, 40, 12)
    for crowd in (100_000, 3):
        got = turn_repair.Repair(turn_repair.damaged(frame(spark, rows)), crowd=crowd, part_bytes=500).turns().collect()
        by = defaultdict(list)
        for x in sorted((x for x in got if x.position >= 0), key=lambda x: (x.part, x.position)):
            by[x.conv_id].append(f"{x.role}:{x.text}")
        want = report(rows)
        assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in by.items()} == {c: w[-1] for c, w in want.items() if by.get(c)}


def test_repair_edges(spark):
    assert turn_repair.repaired(frame(spark, [])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (5, 1, "user", "word. " * 60_000), (5, 2, "assistant", None), (6, -(2**63), "user", "a."), (6, 2**63 - 1, "assistant", "b.")]
    got, want = as_dict(turn_repair.repaired(frame(spark, rows))), report(rows)
    assert got[6][0] == 2**63 - 1 and want.pop(6)[1:] == got.pop(6)[1:]
    assert got == want and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# phrases


def brute_collocations(rows, least, top, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if a >= f[lang, w[i : i + m]]:
                    dropped.add((lang, w[i : i + m]))
    best = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, k, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in best.items() for k, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1)}


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "xx", "\x00", "ab", "of", "the", "q1", "　", "long" * 40]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]
    return [
        (r.choice(("en", "en", "en", "de", None)), None if r.random() < 0.02 else "".join(r.choice(words[: r.randint(2, 12)]) + r.choice(ends) for _ in range(r.randint(0, 40))))
        for _ in range(n)
    ]


def collocations(spark, rows, **more):
    df = spark.createDataFrame([(k if k % 5 else None, t, lang, "s", k) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, phrase long")
    got = [tuple(r) for r in phrase_mining.collocations(df.repartition(5), **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("more", [{}, {"split_bits": 3, "range_bytes": 2_000}, {"top": 7}])
def test_collocations(spark, more):
    rows = texts(1, 400) + [("en", "a b c a b")] * 40
    assert collocations(spark, rows, least=10, **more) == brute_collocations(rows, 10, more.get("top", 2000))


def test_collocations_edges(spark):
    assert collocations(spark, [(None, None)] * 3) == set() and collocations(spark, [("en", "")]) == set()
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrase_mining.collocations(df).count() == 0
    # one very long text, with a passage that is one word over and over, and one of a break in every place
    rows = [("en", "one two three. " * 120_000 + "ha " * 600_000 + "," * 100), ("en", "x" * 5_000_000)]
    assert collocations(spark, rows) == brute_collocations(rows, 100, 2000)


# packing


def pack(spark, texts, **more):
    """Pieces of texts, each checked: every id in exactly one piece, sequences without gaps, none padded."""
    library = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    df = spark.createDataFrame([(k, t, 1, "x", b"x") for k, t in enumerate(texts)], "doc_id long, text string, rest long, part string, ids binary")
    got = packing.packed(df.repartition(3), **more).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length > 0 and x.doc_tokens == len(ids[x.doc_id]) and x.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert "ids" not in x or x.ids == part
        by[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
    assert sorted(by) == [*range(len(texts))]
    for ends, total in [(by[k], len(ids[k])) for k in by] + [(s, sum(n for _, n in s)) for s in sequences.values()]:
        assert [a for a, _ in sorted(ends)] == [0, *itertools.accumulate(n for _, n in sorted(ends))][:-1] and sum(n for _, n in ends) == total
    full = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in full) and sum(n < 1024 for n in full) <= 10
    return got


def test_packing(spark):
    r = random.Random(6)
    odd = ["", " ", "\n", "the", " The", "é", "<|endoftext|>", "<|endof", "'s", " 12", "\t ", "\U0001f600", "　"]
    texts = ["".join(r.choice(odd[: r.choice((5, 13))]) for _ in range(r.choice((3, 40, 300, 1500)))) for _ in range(400)] + [None, ""] * 150
    texts += ["a" * 5000, "word " * 300_000, " " * 3000, "x" * 100_000, "b\u00a0 " * 400_000]
    pack(spark, texts, with_ids=True)


def test_packing_edges(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(pack(spark, [None])) == 1
    pack(spark, ["the " * 699] * 500)  # one length, which fills no sequence exactly: all are cut
    same = spark.createDataFrame([(None, "a b")] * 5 + [(7, "a b")] * 5, "doc_id long, text string")
    assert {(x.start, x.length, x.doc_tokens) for x in packing.packed(same).collect()} >= {(0, 3, 3)}


ODD = [*"''strevlmd  \n\taZé1²٣!.\u00a0\u3000\u0085\x1c\u2028中😀𝟘\u0301ñ\u200b\ufeffǅⅧ\0S", "слово", "<|endoftext|>", "<|endof", "text|>"]


def odd_texts(r):
    some = r.sample(ODD, r.choice((5, 12, 25, len(ODD))))
    return ["".join(r.choice(some) for _ in range(r.choice((0, 1, 2, 3, 5, 20, 60)))) for _ in range(r.choice((1, 3, 8)))]


def test_matches_start_where_the_pattern_has_them():
    r, find = random.Random(3), regex.compile(public_tokenizers.PATTERN).finditer
    for _ in range(1500):
        texts = [t.replace("|", "!") for t in odd_texts(r)]
        data, offsets = text_buffer(pa.array(texts))
        want = {*offsets.tolist()} | {at + len(t[: m.start()].encode()) for t, at in zip(texts, offsets.tolist()) for m in find(t)}
        if len(data):
            assert np.flatnonzero(packing.match_starts(data, offsets)).tolist() == sorted(want), texts


def test_ids_are_the_librarys_whatever_is_remembered():
    r, library, made = random.Random(4), Tokenizer.from_file(public_tokenizers.path(packing.MODEL)), packing.Library(public_tokenizers.path(packing.MODEL))
    for _ in range(1500):
        texts = odd_texts(r)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, count = made.encode(pa.array([*texts, None]), r.choice((10, 100, 600_000)))
        assert ids.tolist() == [x for t in want for x in t] and count.tolist() == [*map(len, want), 0], texts


def test_matches_met_again_are_kept():
    made = packing.Library(public_tokenizers.path(packing.MODEL))
    for k in range(20):
        made.encode(pa.array([" the of" + "".join(f" q{k}x{j}" for j in range(9))]), 30)
        assert len(made.known) <= 30 + 40 and (k == 0 or " the" in made.known)
    made.encode(pa.array([" the of"]), 0)  # nothing may be remembered, so all go and come anew
    assert [*made.known] == [" the", " of"]


def test_known_words_cost_less_than_finding_them():
    """Tokens of a text cost less than finding its matches as objects, of which one was made for every match."""
    text, made = "the quick brown fox jumps over the lazy dog " * 60_000, packing.Library(public_tokenizers.path(packing.MODEL))
    find, texts = re.compile(r" ?[a-z]+|\s+(?!\S)|\s+").findall, pa.array([text])
    made.encode(texts, 600_000)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: made.encode(texts, 600_000)) < least(lambda: find(text))


def test_long_texts_in_parts(spark):
    long = ["word l'a 12 " * 250_000, "слово\u00a0 " * 150_000 + "x y" * 500_000]
    for text in long:
        pack(spark, [text])
    pack(spark, [*long, "a"])


def test_columns_cover_nearly_all():
    """Whole documents are most: what is cut is the little that exact patterns can't cover."""
    r = np.random.default_rng(1)
    p = np.exp(-np.arange(300) / 60)
    histogram = {k + 1: int(c) for k, c in enumerate(r.multinomial(1_000_000, p / p.sum())) if c}
    plan = packing.Plan(histogram)
    assert plan.in_line < 0.01 * plan.rests
    small = packing.Plan({5: 7, 3: 4, 2: 1}, 8, 100)
    places = [x for n, c in ((5, 7), (3, 4), (2, 1)) for k in range(c) for x in small.places(n, k)]
    assert sum(n for _, n, _, _ in places) == 49 and len({(s, at) for _, _, s, at in places}) == len(places) and small.in_line == 4


def test_best_pattern_is_the_best():
    r = random.Random(2)
    for _ in range(50):
        lengths = np.array(sorted(r.sample(range(1, 12), 4), reverse=True))
        value = np.array([r.random() for _ in lengths])
        every = [c for c in itertools.product(*(range(12 // n + 1) for n in lengths)) if sum(c * lengths) == 12]
        got, counts = packing.best_pattern(lengths, value, 12)
        assert (got == -np.inf and not every) or (tuple(counts) in every and abs(got - max(sum(c * value) for c in every)) < 1e-9)
