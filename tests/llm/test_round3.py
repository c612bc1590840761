"""Centroid clustering, exact dedup and the prefix trie against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import clustering, exact_dedup, hot, passages, prefix_trie

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def lloyd(rows, k, rounds, dim):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 by plain loops."""
    kept = [(i, [floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < float("inf") for x in v)]
    order = sorted(kept, key=lambda x: (sha(f"1:{'null' if x[0] is None else x[0]}"), x[1]))
    centroids = [v for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            own[j].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centroids)]
    last = assign()
    sums = Counter()
    for d, j in last:
        sums[j] += d
    return Counter((i, j, d, sums[j], sum(sums.values()), sha(",".join(map(str, centroids[j])))) for (i, _), (d, j) in zip(kept, last))


def test_clusters_against_brute_force(spark):
    r = np.random.default_rng(4)
    for dim, k, scale in ((64, 16, 0.1), (3, 5, 0.05), (1, 7, 0.02)):
        rows = [(i, [float(x) for x in r.normal(0, scale, dim) + (i % 3)]) for i in range(150)]
        rows += [(200, None), (201, [float("nan")] * dim), (202, [None] * dim), (203, []), (204, [1.0] * (dim + 1)), (205, [float("inf")] * dim), (None, [0.1] * dim), (3, rows[3][1]), (3, rows[4][1]), (206, [0.0] * dim), (207, [0.0] * dim)]
        frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
        assert Counter(map(tuple, clustering.cluster(frame, k, 3, dim).collect())) == lloyd(rows, k, 3, dim)
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [1e300] * 64)], "vec_id long, embedding array<double>")
    assert {x.vec_id: x.distance for x in clustering.cluster(few).collect()} == {1: 0, 2: 0}
    assert clustering.cluster(few.limit(0)).collect() == []


def test_nearest_with_ties_and_equal_norms():
    r = np.random.default_rng(9)
    centroids = r.integers(-3, 4, (40, 4))
    v = r.integers(-3, 4, (500, 4))
    which, best = clustering.nearest(v, centroids)
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (which == d.argmin(axis=1)).all()


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out[i, keep, len(ids), bool(kept), sha(t)] += 1
    return out


def texts(r):
    long = " ".join(f"w{r.randrange(10**6)}" + "." * (k % 9 == 0) for k in range(4000))
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, long), (101, long), (102, long[:-1]), (103, long.replace("w", "v", 1)), (104, long.upper())]
    rows += [(200, None), (201, ""), (None, ""), (None, None), (202, " "), (203, "x" * 5000), (204, "x" * 5000), (205, "x" * 5001), (None, "only null"), (None, "only null"), (7, "text 0"), (56, "text 0"), (56, "text 0"), (206, "é。" * 900), (207, "é。" * 900)]
    return rows


def test_dedup_against_brute_force(spark):
    rows = texts(random.Random(2))
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, recipe string").repartition(5)
    weak = lambda chunk, turn: F.lit("00" * 16) if turn == 0 else F.concat(F.lit("00" * 15), F.substring(F.md5(chunk), 1, 2)) if turn == 1 else exact_dedup.identifier(chunk, turn)
    for identify in (exact_dedup.identifier, weak):  # the weak ones are found out and not used
        got = exact_dedup.groups_of_equals(frame, identify).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert Counter(map(tuple, got)) == copies(rows)
    kept = exact_dedup.without_copies(frame)
    assert kept.columns == frame.columns and Counter((x.doc_id, x.text or "") for x in kept.collect()) == Counter({(max((i for i, u in rows if (u or "") == t and i is not None), default=None), t): 1 for t in {t or "" for _, t in rows}})
    assert exact_dedup.groups_of_equals(frame.limit(0)).collect() == []


def test_dedup_of_bytes_that_are_no_text(spark):
    frame = spark.sql("SELECT id AS doc_id, CASE id WHEN 0 THEN CAST(X'61FF' AS STRING) WHEN 1 THEN CAST(X'61FE' AS STRING) WHEN 2 THEN '61FF' WHEN 3 THEN CAST(X'61FF' AS STRING) END AS text FROM range(4)")
    assert {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup.groups_of_equals(frame).collect()} == {0: (3, 2), 1: (1, 1), 2: (2, 1), 3: (3, 2)}


def test_chunks_give_the_text_back(spark):
    rows = texts(random.Random(3))
    frame = spark.createDataFrame(rows, "doc_id long, text string").filter("text IS NOT NULL").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for x in frame.collect():
        assert "".join(x.c) == x.text and all(0 < len(c) <= exact_dedup.MOST_CHUNK for c in x.c)


def test_attached_hot_and_cold_groups(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(i, "h" if i % 2 else f"k{i % 10}") for i in range(100)] + [(200, "z")], "i long, k string")
    groups = rows.filter("k != 'z'").groupBy("k").agg(F.count("*").alias("n")).withColumn("m", F.col("n"))
    want = {i: 50 if i % 2 else 10 for i in range(100)}
    assert {x.i: x.m for x in hot.attached(rows, groups, ["k"], 100).collect()} == want
    assert {x.i: x.m for x in hot.attached(rows, groups, ["k"], 100, "left").collect()} == want | {200: None}
    monkeypatch.setattr(hot, "BROADCAST_BYTES", 0)
    assert {x.i: x.m for x in hot.attached(rows, groups, ["k"], 100).collect()} == want


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].split()) if k else 0
    return {(m[0], len(k)): (members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(built[c]) == len(k)))) for k, m in members.items()}


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "ENDS", 4)
    r = random.Random(8)
    rows = []
    for c in [*range(0, 45), *range(61, 75), 1000, 1019]:  # 60 and more are missing: their families may be turnless
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice("ua"), r.choice(["a b", "c", "d e f"])))
    rows += [(80, t, "user", f"long {t % 5}") for t in range(70)] + [(85, t, "user", f"long {t % 5}") for t in range(67)]
    rows += [(c, t, "system", "the same words") for c in range(200, 260) for t in range(4)]
    rows += [(90, None, None, None), (90, None, "x", "null first"), (90, 1, "x", "tie"), (90, 1, "x", "eit"), (90, 1, "x", "eit"), (None, 1, "u", "nobody"), (91, 0, "", ""), (91, 1, "1:", ""), (92, 1, None, "")]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, 1, "s") for x in rows], "conv_id long, turn long, role string, text string, depth int, digest string")
    got = {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in prefix_trie.trie(frame).collect()}
    assert got == brute_trie(rows)


def test_trie_of_turnless_and_of_no_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    lone = next(c for c in range(100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefix_trie.trie(spark.createDataFrame([(lone, 0, "u", "gone")], kind)).collect()
    assert [tuple(x) for x in got] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == []


def edited(r, words, at):
    """A passage with other words at places."""
    return [f"new{r.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]


def test_passages_of_chains_of_edits(spark):
    """Each document is near the one before it and further from the first: all must be found, though earlier ones are done."""
    r = random.Random(31)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    alone = lambda p: " ".join(words(60) + p + words(60))
    rows, last = [], []
    for k in range(40):  # P, A, X with similarities of 0.80, 0.80 and 0.64
        p = words(50)
        a = edited(r, p, {12 + k % 5})
        x = edited(r, a, {30 + k % 7})
        rows += [(3 * k + i, alone(y)) for i, y in enumerate((p, a, x))]
        last += [3 * k + 1, 3 * k + 2]
    for k in range(20):  # chains of four, 60 words
        p, chain = words(60), []
        for i in range(4):
            chain.append(alone(p))
            p = edited(r, p, {6 + 15 * i})
        rows += [(1000 + 4 * k + i, y) for i, y in enumerate(chain)]
        last += [1000 + 4 * k + i for i in (1, 2, 3)]
    for k in range(20):  # one edit at a similarity of 0.9
        p = words(110)
        rows += [(2000 + 2 * k, alone(p)), (2001 + 2 * k, alone(edited(r, p, {50})))]
        last.append(2001 + 2 * k)
    got = defaultdict(set)
    for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 60 - 5 <= x.start_word and x.source_id < x.doc_id
        got[x.doc_id] |= set(range(x.start_word, x.end_word))
    whole = [i for i in last if len(got[i]) >= 44]
    assert len([i for i in whole if i < 1000 and i % 3 == 2]) >= 38 and len(whole) >= 0.95 * len(last)
    assert not set(got) - set(last)


def test_passages_of_equal_texts(spark):
    r = random.Random(5)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    rows = [(9, text), (2, text), (5, text), (5, text), (None, text), (7, "short text"), (8, "short text"), (10, text + " more")]
    got = {(x.doc_id, x.start_word, x.end_word, x.source_id) for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 0, 80, 2), (5, 0, 80, 2), (10, 0, 80, 2)}


def layouts(r):
    """Pages of layouts with and without article, and their main texts."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    head, paras = words(4, 8), [words(30, 90) for _ in range(r.randint(3, 8))]
    p = "".join(f"<p>{x}</p>" for x in paras)
    menu = "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(4, 9))) + "</ul>"
    comments = "".join(f"<div><p>{words(20, 60)}</p></div>" for _ in range(r.randint(1, 12)))
    text = " ".join([head, *paras])
    h1, foot = f"<h1>{head}</h1>", f"<footer><p>{words(10, 30)}</p></footer>"
    yield f"<body><nav>{menu}</nav><article>{h1}{p}</article>{foot}</body>", text
    yield f"<body><header>{menu}</header><div class='content has-sidebar'>{h1}{p}</div><div class='sidebar'>{menu}<p>{words(20, 40)}</p></div>{foot}</body>", text
    yield f"<body><div>{menu}</div><div class='post'>{h1}{p}</div><div id='comments'>{comments}</div></body>", text
    yield f"<body>{menu}<div>{h1}{p}</div>{menu}</body>", text
    yield f"<body><div id='wrapper'><div class='elementor-widget elementor-widget-heading'>{h1}</div><div class='elementor-widget elementor-widget-text-editor'>{p}</div></div></body>", text
    yield f"<body><main>{h1}<div class='ad'>{words(5, 12)}</div>{p}<aside>{words(30, 60)}</aside><section class='comment-list'>{comments}</section></main></body>", text
    sub = words(2, 3)
    yield f"<body><article>{h1}{p}<h2 class='social-history'>{sub}</h2><p>{paras[0]}</p></article></body>", f"{text} {sub} {paras[0]}"
    yield f"<body><article>{h1}{p}</article><div class='related'><article><a href=x>{words(3, 6)}</a></article></div></body>", text
    yield f"<table><tr><td>{menu}</td><td>{h1}{p}</td></tr></table>", text
    yield f"<body><div class='cookie-notice'><p>{words(6, 10)}</p><button>ok</button></div><div class='page'>{h1}{p}</div><div>{menu}</div></body>", text


def test_main_text_of_layouts():
    """The article alone, whatever the layout; without window sums other lines would be in it."""
    from eventloom.llm import html_text

    r = random.Random(77)
    changed = 0
    for _ in range(60):
        for n, (page, text) in enumerate(layouts(r)):
            got = html_text.main_text(page)
            assert got == text, (n, got[:300], text[:300])
            found, around = html_text.lines(page)
            every = [line[0] for line, w in zip(found, html_text.weights(found, around)) if w is not None]
            changed += " ".join(every) != text
    assert changed >= 200  # of 600 pages


def test_surge_and_dive_decide_without_an_article():
    from eventloom.llm import html_text

    long = "words of a sentence that goes on for some time and says what it has to say, "
    short = "".join(f"<div>{x}</div>" for x in ("Print", "Send", "Up", "Top", "A B"))
    page = f"<body><div>{'Today'}</div>{short}<div>{long * 2}</div><div>{long}</div><div>Yes.</div><div>{long}</div>{short}<div>{long * 3}</div>{short}</body>"
    lines = [(long * 2).strip(), long.strip(), "Yes.", long.strip(), (long * 3).strip()]
    got = html_text.main_text(page)
    # the short line between long ones stays; the runs of short ones around them, which surge nowhere, mostly go
    for x in lines:
        assert x in got
    assert got.count("Send") + got.count("Up") + got.count("Top") < 9 and not got.startswith("Today")
    assert html_text.main_text(page, dive=1) != got and html_text.main_text(page, dive=1).startswith("Today")
