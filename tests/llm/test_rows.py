"""Operators on single texts: packing, licences, quality, BPE, sharding, fingerprints, chats, repeats, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from planquarry.llm import bpe, chat, fingerprints, licenses, packing, quality, repeats, sharding
from tests.llm.cases import UPPER, documents, frame, table_dir

WORD, BYTE = bpe.vocabulary("word_bpe_49k.json"), bpe.vocabulary("byte_bpe_50k.json")


def odd_texts(n=300):
    r = random.Random(4)
    signs = list("aAbB zZ  \n\t.,!?'s|<>0159éÉüßñİıΣς ́漢字🙂\x00\x1c\x85½²ªµŉ") + ["'re", "<|endoftext|>", "<|startoftext|>", "  ", " the", "\n "]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_packing_covers_every_id_once(spark, tmp_path):
    rows = documents() + [(9000 + k, t) for k, t in enumerate(odd_texts(120))]
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(3))
    pieces = packing.op2_packing(spark, sf).collect()
    library, by_doc, by_sequence = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            raw = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * 2048 * len(by_sequence)


def test_packing_empty_and_repeated(spark):
    assert packing.pack(frame(spark, []), WORD).count() == 0
    assert packing.pack(frame(spark, [(1, "a"), (1, "a")]), WORD).count() == 2


def test_best_cuts_are_cheapest():
    r = random.Random(2)
    for _ in range(40):
        pos = [0]
        while len(pos) < 14:
            pos.append(pos[-1] + r.randint(1, 9))
        penalty = [0] + [r.choice([0, 3, 9]) for _ in pos[1:]]
        cuts = packing.best_cuts(np.array(pos), np.array(penalty), 10)
        cost = lambda c: sum(10 - pos[b] + pos[a] + penalty[b] for a, b in zip(c, c[1:]))
        best = [0] + [None] * 13
        for j in range(1, 14):
            best[j] = min(best[i] + 10 - pos[j] + pos[i] + penalty[j] for i in range(j) if pos[j] - pos[i] <= 10)
        assert cuts[0] == 0 and cuts[-1] == 13 and cost(cuts) == best[13]


def test_bpe_is_the_librarys(spark, tmp_path):
    rows = documents() + [(9000 + k, t) for k, t in enumerate(odd_texts())]
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(3))
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, sf).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_encode_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 4000)
    rows = [(i, t) for i, t in documents() if "<|" not in (t or "")]
    ids = bpe.encode(frame(spark, rows), BYTE)
    assert {r.doc_id: r.text for r in bpe.decode(ids, BYTE).collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode(frame(spark, []), BYTE).count() == 0


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_licences_base_columns(spark, tmp_path):
    rows = documents() + [(9000, "license mit license apache license license general public license"), (9001, "MIT\x00LICENSE")]
    rows += [(9002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (9003, "permission granted")]
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows))
    got = {r.doc_id: r for r in licenses.op4_licenses(spark, sf).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in rows:
        words = licence_words(text)
        places = [(k, name) for p, name in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r, starts, names = got[i], [k for k, _ in places], sorted({n for _, n in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(names),
        )
        assert set(names) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[9002].labels == "mit" and got[9002].n_base == 0 and got[9003].labels == ""


def licences_by_hand(text):
    """(labels, score) from every place of every template."""
    words, labels, score = licence_words(text), set(), 0.0
    for label, base, template, must in licenses.TEMPLATES:
        all_words, phrase = template.split(), must.split()
        off = next(i for i in range(len(all_words)) if all_words[i : i + len(phrase)] == phrase)
        own = [(i, w) for i, w in enumerate(all_words) if len(w) > 2 and w not in licenses.COMMON]
        at = lambda k: words[k] if 0 <= k < len(words) else None
        for start in range(-len(all_words), len(words)):
            share = sum(at(start + i) == w for i, w in own) / len(own)
            ok = all(at(start + off + i) == w for i, w in enumerate(phrase))
            if share >= licenses.SHARE and (ok or not base):
                score = max(score, share if ok else share / 2)
                labels |= {label} if ok else set()
    return ",".join(sorted(labels)), score


def test_licences_match_brute_force(spark):
    r = random.Random(11)
    texts = ["This work has no rights reserved", "some rights reserved", "All rights reserved.", "rights of the king", "permission is hereby granted"]
    texts += ["permission was hereby granted, free to charge by any person obtaining one copy at that software"]
    pool = sorted({w for t in licenses.TEMPLATES for w in t[2].split()}) + ["foo", "bar"]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 3)):
            w = r.choice(licenses.TEMPLATES)[2].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(pool)
            parts += w[r.randint(0, 2) :] + [r.choice(pool) for _ in range(r.randint(0, 4))]
        texts.append(" ".join(parts))
    got = licenses.scan(frame(spark, list(enumerate(texts)))).collect()
    for x in got:
        labels, score = licences_by_hand(texts[x.doc_id])
        assert (x.labels, round(x.score, 9)) == (labels, round(score, 9)), texts[x.doc_id]
    by = {texts[x.doc_id]: x for x in got}
    assert not by["This work has no rights reserved"].labels and by["All rights reserved."].labels == "proprietary" and by["rights of the king"].score == 0


def test_licences_long_text(spark):
    """Work grows with a text's hits, not with their square."""
    [x] = licenses.scan(frame(spark, [(1, "mit license " * 20_000)])).drop("places").collect()
    assert (x.n_words, x.n_base, x.first_word, x.last_word, x.labels, x.score) == (40_000, 20_000, 0, 39_998, "mit", 1.0)


def test_licences_empty_and_repeated(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    assert [r.n_base for r in licenses.scan(frame(spark, [(1, "mit license"), (1, "mit license")])).collect()] == [1, 1]


def quality_rows(n=240):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 80))]
        good = i % 3 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out_accuracy(spark, tmp_path):
    rows, labels = quality_rows()
    rows += [(5000, None), (5001, ""), (5002, "x"), (5002, "x")]
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.op5_quality(spark, sf).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def test_quality_ignores_other_columns_and_held_out_labels(spark):
    rows, labels = quality_rows()
    docs = frame(spark, rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels]
    scores = []
    for part in (labels, flipped):
        machine = quality.train(docs, spark.createDataFrame(part, "doc_id long, quality int, toxic int").where(~quality.fold()))
        scores.append({r.doc_id: r.score for r in quality.score(docs, machine, "doc_id").collect()})
    assert scores[0] == scores[1]


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)])
    machine = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == pytest.approx(0.5, abs=0.3) for r in quality.score(docs, machine, "doc_id").collect())
    assert quality.score(frame(spark, []), machine, "doc_id").count() == 0


def test_machine_identity():
    """The sum of squares equals the sum over all pairs."""
    m = quality.Machine(np.zeros((quality.STATS, quality.BINS - 1)), 1)
    stats, bucket, at = np.zeros((1, quality.STATS)), np.array([3, 9, 3]), np.array([0, 3])
    linear, s, q = m.sums(m.bins(stats), bucket, at)
    x = [(int(b), 1 / 3) for b in bucket] + [(int(b), 1.0) for b in m.bins(stats)[0]]
    pairs = sum((m.v[a] @ m.v[b]) * u * w for k, (a, u) in enumerate(x) for b, w in x[k + 1 :])
    assert ((s**2).sum(1) - q)[0] / 2 == pytest.approx(pairs)


@pytest.mark.parametrize("hot", [0, 200])
def test_sharding_sizes(spark, tmp_path, hot):
    rows = documents(near=60) + [(9000 + k, f"text {k} " * (k % 40)) for k in range(900)] + [(20000 + k, "the same text " * 9) for k in range(hot)]
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(4))
    got = sharding.op7_sharding(spark, sf).collect()
    assert len(got) == len(rows) and {r.shard for r in got} <= set(range(16)) and {r.law for r in got} == {"bytes"}
    texts = dict(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(size.values()), max(r.size for r in got)
    assert max(size.values()) - total / 16 <= 0.01 * total / 16 + 2 * largest


def test_sharding_keeps_small_groups_together(spark):
    rows = [(k, f"text {k // 3} ") for k in range(3000)]
    got = sharding.shard(frame(spark, rows), tolerance=0.02).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.doc_id // 3].add(r.shard)
    assert all(len(v) == 1 for v in groups.values())


def test_sharding_empty_and_repeated(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    got = sharding.shard(frame(spark, [(1, None)] * 40)).collect()
    assert len(got) == 40 and {r["size"] for r in got} == {1}


@pytest.mark.parametrize("ids", [(1, 2), (None, None), (None, 7)])
def test_sharding_spreads_repeated_rows(spark, ids):
    got = sharding.shard(frame(spark, [(ids[0], None)] * 400 + [(ids[1], "x")] * 400).repartition(3)).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 800 and sum(size.values()) == 1200
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 4
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_fingerprints(spark, tmp_path):
    rows = documents()
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(3))
    got = {r.doc_id: tuple(r) for r in fingerprints.op8_fingerprints(spark, sf).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        s = fingerprints.signatures([text.encode(), edited.encode(), following.encode()])
        h = fingerprints.in_hex(s)
        assert got[i] == (
            i, n, hashlib.sha256(edited.encode()).hexdigest(), h[0], h[1],
            fingerprints.likeness(s[:1], s[1:2])[0], fingerprints.likeness(s[:1], s[2:])[0],
        )


def test_phrases_do_not_depend_on_the_offset():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)).encode()
    plain, moved, other = fingerprints.signatures([text, b"some other words before " + text, text[::-1]])
    assert fingerprints.likeness(plain[None], moved[None])[0] > 0.8
    assert fingerprints.likeness(plain[None], other[None])[0] < 0.1


def test_short_texts_share_phrases_with_their_edited_halves():
    """Half of a text of 20 to 60 bytes stays as it is; hardly any fingerprint may lose all of it."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(30))[: r.randint(20, 60)] for _ in range(400)]
    edited = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for t, o in zip(texts, texts[1:] + texts[:1])]
    own, marks = (fingerprints.signatures([t.encode() for t in ts]) for ts in (texts, edited))
    assert (fingerprints.likeness(own, marks) == 0).mean() <= 0.02
    assert fingerprints.likeness(own, np.roll(own, -1, 0)).mean() < 0.02


def test_fingerprints_empty(spark):
    assert fingerprints.edited_pairs(frame(spark, [])).count() == 0
    one = fingerprints.edited_pairs(frame(spark, [(4, None)])).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in one] == [(0, 1.0, 1.0)]
    assert fingerprints.edited_pairs(frame(spark, [(4, "a b"), (4, "a b")])).count() == 2


def test_chats_are_read_back(spark, tmp_path):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "\\<|", "<\\|", "<", "|>", "\\", None, "", "漢字🙂", "a\n\nb", "<|<|\\\\<|"]
    rows = [(c, t, ["system", "user", "assistant"][min(t, 2 - t % 2)] if t else "user", odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(5)]
    rows += [(50, 0, "assistant", "first"), (50, 0, "assistant", "first"), (51, 1, None, "x"), (51, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", chat.F.lit(1))
    sf = table_dir(spark, tmp_path, conversations=df)
    got = {r.conv_id: r for r in chat.op9_chat_formatting(spark, sf).collect()}
    rows += [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[50].bad_turn == 0 and not got[50].valid and got[-1].valid


def test_chats_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def cut_by_hand(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            if raw[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(raw[s : s + n])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent, crowd", [(200, 2000), (4, 2000), (4, 3), (200, 1)])
def test_repeats_match_brute_force(spark, tmp_path, frequent, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "HELD", 500)
    rows = documents(near=40, passage=40)
    sf = table_dir(spark, tmp_path, documents=frame(spark, rows).repartition(5))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op10_repeats(spark, sf).collect()}
    assert got == cut_by_hand(rows)


def test_repeats_pass_over_texts_three_times(spark, monkeypatch):
    """Anchors, segments, and what is left of both kinds together: windows of crowded anchors had a pass of their own."""
    from pyspark.sql.classic.dataframe import DataFrame

    passes, run = [], DataFrame.mapInArrow

    def seen(self, f, *rest):
        if "text" in self.columns:
            passes.append(f.__name__)
        return run(self, f, *rest)

    monkeypatch.setattr(DataFrame, "mapInArrow", seen)
    monkeypatch.setattr(repeats, "CROWD", 1)
    rows = documents(near=40, passage=40)
    assert repeats.repeated_spans(repeats.with_marks(frame(spark, rows))).count() > 0 and len(passes) == 3


def test_repeats_empty_and_repeated(spark):
    assert repeats.cut_repeats(frame(spark, [])).count() == 0
    # The text has a period of 26, so it repeats inside itself; equal rows of one id are one document.
    text = "".join(chr(97 + (k * k) % 26) for k in range(150)) + "end"
    got = repeats.cut_repeats(frame(spark, [(2, text), (2, text), (1, None), (3, "x" + text)])).collect()
    by_hand = cut_by_hand([(1, None), (2, text), (3, "x" + text)])
    assert sorted(tuple(r) for r in got) == sorted((i, *by_hand[i]) for i in (1, 2, 2, 3))


def test_repeats_null_ids(spark):
    """Texts without an id are told apart by their whole hashes and come before all others."""
    shared = "".join(chr(97 + (k * k * k + 5 * k) % 23) + "%03d" % k for k in range(60))
    rows = [(None, "first " + shared), (None, "second one " + shared), (4, shared + " tail")]
    got = sorted((r.doc_id is None, r.n_bytes - r.n_removed) for r in repeats.cut_repeats(frame(spark, rows)).collect())
    # One of the two without an id keeps all, the other its own head (the space before the passage is common, too);
    # of the third only its tail is left.
    assert got[0] == (False, 5) and got[1][1] + got[2][1] == 5 + 10 + 1 + len(shared)


def test_long_prefixes_by_sorting():
    r = random.Random(6)
    bodies = ["".join(r.choice("ab") for _ in range(r.randint(5, 40))).encode() for _ in range(30)]
    text, ends = [], []
    for b in bodies:
        text += [x + 1 for x in b] + [0]
        ends.append(len(text) - 1)
    text = np.array(text)
    order, border = repeats.long_prefixes(text, np.array(ends), 6)
    suffix = lambda p: tuple(text[p : p + list(text[p:]).index(0)])
    assert [suffix(p)[:6] for p in order] == sorted(suffix(p)[:6] for p in range(len(text)))
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert border[k] == (common < 6)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_rows()
    good = " ".join(f"word{k}" for k in range(80))
    passage = " ".join(f"pass{k}" for k in range(40))
    fresh = lambda k: " ".join(f"{'abcdefghij'[k]}{j:02d}xy" for j in range(40))
    rows += [(7000, good), (7001, good), (7002, good + " tail"), (7010, fresh(0) + " " + passage), (7011, fresh(1) + " " + passage), (7020, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = table_dir(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    state, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf)
        assert state.columns == docs.columns
        state = spark.createDataFrame(state.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in state.collect()})
    bad = {i for i, y, _ in labels if not y}
    assert len(bad & set(kept[0])) <= 0.05 * len(bad) and len({i for i, y, _ in labels if y} - set(kept[0])) <= 0.05 * len(labels)
    assert 7000 in kept[1] and not {7001, 7002} & set(kept[1])
    assert passage in kept[2][7010] and passage not in kept[2][7011]
    assert corpus_pipeline.run(spark, sf).count() >= len(kept[2])


def test_null_ids_everywhere(spark, tmp_path):
    """Rows without an id are rows like others."""
    rows = [(None, "mit license " * 30), (None, None), (3, "mit license " * 30), (None, "mit license " * 30), (4, "other text")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(3, 1, None), (None, 0, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    sf = table_dir(spark, tmp_path, documents=docs, labels=labels)
    for query in (packing.op2_packing, licenses.op4_licenses, quality.op5_quality, bpe.op6_bpe, sharding.op7_sharding, fingerprints.op8_fingerprints, repeats.op10_repeats):
        got = query(spark, sf).collect()
        assert sum(r.doc_id is None for r in got) >= (3 if query is not fingerprints.op8_fingerprints else 0) and len(got) >= 5
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() >= 1


def test_every_word_of_a_mandatory_phrase_counts(spark):
    from planquarry.llm import licenses

    rest = "source and binary forms with or without modification are permitted"
    rows = [
        (1, "All rights reserved.", "proprietary", 1.0),
        (2, "Some rights reserved.", "", 0.5),
        (3, "no rights reserved, all of them", "", 0.5),
        (4, "rights reserved", "", 0.5),
        (5, f"Redistribution and use in {rest}", "bsd", 1.0),
        (6, f"Redistribution nor use of {rest}", "", 0.5),
        (7, "Permission to use, copy, modify and or distribute this software for any purpose", "isc", 1.0),
        (8, "Permission never use, copy, modify and or distribute this software for any purpose", "", 0.5),
        (9, "all all rights reserved", "proprietary", 1.0),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {i: (labels, score) for i, _, labels, score in rows}
