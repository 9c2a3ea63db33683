"""Each operator against a brute-force version, on a small fixture of odd rows and on the smallest documents table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from spanwright.llm import html_density, imatch, language, line_dedup, mixing, near_copies, packing, pii, quality, sharding, simhash

SP = " \t\n\x0b\x0c\r"
LONG = "The same long line here"
ROWS = [
    (1, f"{LONG}\nunique one é\n{LONG}", "en", "a"),
    (2, f"  {LONG.upper()}\t\nshort", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, f"{LONG}\nunique one é\n{LONG}", "en", "a"),
    (5, f"{LONG}\nunique one é\n{LONG}", "en", "a"),
    (None, f"x\n{LONG}", "de", "b"),
    (7, "mail a.b@c.de_f@g.hi, 1.2.3.4.5.6.7.8 300.1.1.1 +1 (555) 123-4567; 4111 1111 1111 1111 x 4111-1111-1111-1112 é@x.y", "fr", "b"),
    (8, "a b c d e f g h " * 40, "en", "b"),
    (9, "w" * 5000 + " " + "1" * 5000 + ".".join(["a"] * 3000) + "@", "en", "c"),
    (10, "\n\n\n", "es", "c"),
    (11, "word " * 9000, "xx", "c"),
    (12, "Привет мир, это русский текст", "ru", "c"),
    (13, "12 34 !!", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators use themselves
    d = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({"id": F.lit("x"), "fp": F.lit(1), "n_words": F.lit(2), "kept": F.lit("k"), "u": F.lit(1), "hi": F.lit(0), "copies": F.lit(3), "g": F.lit("y"), "piece": F.lit(9)})


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(params=["rows", "none"])
def any_docs(request, docs, real):
    """The odd rows and the real ones in one table, or none."""
    both = docs.unionByName(real.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    return both if request.param == "rows" else docs.limit(0)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 -------------------------------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(any_docs):
    got = pii.find_pii(any_docs).select("doc_id", "base").collect()
    show = sorted((str(r["doc_id"]), str([(pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["base"]])) for r in got)
    assert show == sorted((str(i), str(base(t))) for i, t in texts(any_docs))


def test_pii_many_matches(spark):
    text = "é " + " ".join(f"a{i}@b.co" for i in range(700))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find_pii(d).first()
    assert [("email", x["s"], x["e"]) for x in got["base"]] == base(text)


def test_pii_learns_context(spark):
    rows = [(i, f"intro text\nplease call phone number +1 (555) 000-{i:04d} now") for i in range(20)]
    rows += [(100, "x\nhis phone number 555-0199 now"), (101, "the version 2.0 is out"), (102, "y phone number 555-0177.")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[100]["extra"]] == [(3, 19, 27)] and [tuple(x) for x in got[102]["extra"]] == [(3, 15, 23)]
    assert not got[101]["extra"] and not got[1]["extra"] and len(got[1]["base"]) == 1


def brute_bootstrap(rows):
    """The method again, on plain dicts: (doc_id, kind, start, end) beyond base spans."""
    ws, kinds = "[^ \t\n\x0b\x0c\r]+", [*pii.KINDS, "secret"]
    seen = []
    for i, t in rows:
        t = t or ""
        found = [(kinds.index(k), s, e, s, e) for k, s, e in base(t)]
        for m in re.finditer(rf"{ws}", t):
            if not re.search("[0-9@]", m[0]):
                continue
            core = re.match(r"^[^\w+@]*((?:.*\w)?)", m[0].replace("_", "-"))
            s, e = m.start() + core.start(1), m.start() + core.end(1)
            if e > s and not any(a < e and s < b for _, a, b, _, _ in found):
                found.append((4 if re.search(pii.SECRET, t[s:e]) else None, s, e, m.start(), m.end()))
        for kind, s, e, a, b in found:
            line = t[:a].rsplit("\n", 1)[-1]
            left, rest = line.split(), t[b:].split("\n", 1)[0]
            after = re.sub(rf"^{ws}", "", rest).split()
            ctx = [" ".join(left[-2:]) + " _"] if len(left) > 1 else []
            ctx += [f"^ {left[0]} _"] if len(left) == 1 else []
            ctx += [f"{left[-1]} _ {after[0]}"] if left and after else []
            ctx += [f"_ {after[0]} {after[1]}"] if len(after) > 1 else []
            seen += [(i, kind, s, e, t[s:e], re.sub("[0-9]+", "0", c.lower())) for c in ctx]
    edges, sizes = {(c, x) for *_, x, c in seen}, Counter()
    seeds = {(x, k): 1.0 for _, k, _, _, x, _ in seen if k is not None}
    for c, _ in edges:
        sizes[c] += 1
    scores = dict(seeds)
    for r in range(pii.ROUNDS):
        total, support = Counter(), Counter()
        for c, x in edges:
            for (y, k), v in scores.items():
                if x == y:
                    total[c, k] += v
                    support[c, k] += v >= pii.INSTANCE_SCORE
        conf = {(c, k): v / sizes[c] for (c, k), v in total.items() if support[c, k] >= pii.SUPPORT and v / sizes[c] >= (pii.PATTERN_SCORE if r == pii.ROUNDS - 1 else pii.PATTERN_SCORE / 2)}
        scores = {}
        for c, x in edges:
            for (d, k), v in conf.items():
                if c == d:
                    scores[x, k] = 1 - (1 - scores.get((x, k), 0.0)) * max(1e-9, 1 - v)
        scores |= seeds
    is_seed = {(c, x) for _, k, _, _, x, c in seen if k is not None}
    return {(i, n, s, e) for i, k, s, e, x, c in seen for n in range(5) if k is None and (c, x) not in is_seed and (c, n) in conf and scores.get((x, n), 0) >= pii.INSTANCE_SCORE and re.search(pii.LIKE[n], x)}


def test_pii_bootstraps_like_brute_force(spark):
    """Planted identifiers that the base patterns cannot see: recall over them, and agreement with the method written anew."""
    import random

    rnd = random.Random(6)
    filler = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit") for b in ("a", "em", "um", "or")]
    say = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    rows, planted = [], set()
    for i in range(60):
        shown = [f"Phone: +1 (555) {number(3)}-{number(4)}", f"please write to u{i}.{number(3)}@mail.example.com", f"{say(2)} token = \"{''.join(rnd.choice('0123456789abcdef') for _ in range(40))}\" {say(1)}", f"{rnd.choice('xyz')} host 10.{i}.2.{i} is up {say(1)}"]
        rows.append((i, "\n".join([say(5), *shown, f"version 2.{i} of {say(2)}"])))
    for i in range(60, 75):
        hidden = [(3, f"Phone: ", f"555-{number(4)}"), (0, "please write to ", f"u{i}@localhost"), (4, f"{say(2)} token = ", number(12) + "XY"), (1, f"x host ", f"fe80::{i}:2", " is up")]
        text = say(3)
        for kind, before, value, *more in hidden:
            text += "\n" + before
            planted.add((i, kind, len(text), len(text) + len(value)))
            text += value + (more[0] if more else "")
        rows.append((i, text))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], *x) for r in pii.find_pii(d).collect() for x in r["extra"]}
    seeds = {(i, 4, m.start(1), m.end(1)) for i, t in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert got == brute_bootstrap(rows) | seeds
    assert len(got & planted) >= 0.9 * len(planted) and not {x for x in got - planted if x[1] != 4}


# 2 -------------------------------------------------------------------------------------------
ARTICLE = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{ARTICLE}<p>two &eacute;\n  b<br>c</article><footer>f</footer>", f"T\n{ARTICLE}\ntwo é b c"),
    (f"<div class='sidebar'><p>{ARTICLE}</p></div><div id=main><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div class=comments><p>{ARTICLE}</p></div>", f"{ARTICLE}\n{ARTICLE}"),
    (f"<div><form>{ARTICLE}</form><script>if (a<b) '</p>'</script><p>{ARTICLE} <b>x<p>y {ARTICLE}</div>", f"{ARTICLE} x\ny {ARTICLE}"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p>" + "<" * 3000, "<" * 3000),
])
def test_html(page, text):
    assert html_density.main_text(page) == text


def test_html_link_lists_lose():
    links = "".join(f"<li><a href=/{i}>link text {i}</a></li>" for i in range(40))
    page = f"<div><ul>{links}</ul></div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div>"
    assert html_density.main_text(page) == f"{ARTICLE}\n{ARTICLE}"


def test_html_density_decides():
    """Of two blocks without names the denser one is the article, whatever tags say; teasers in article elements lose."""
    teasers = "".join(f"<article><a href=/{i}>Read more about item {i}</a><p>Now {i}</p></article>" for i in range(9))
    short = "".join(f"<p>Buy {i} now</p>" for i in range(6))
    for other in (teasers, short):
        page = f"<body><div>{other}</div><div><h1>Title</h1><p>{ARTICLE}</p><p>Yes.</p><p>{ARTICLE}</p></div></body>"
        assert html_density.main_text(page) == f"Title\n{ARTICLE}\nYes.\n{ARTICLE}"


@pytest.mark.parametrize("page, text", [
    ("<article><div class='post-header'><h1>Title</h1></div><p>{a}</p></article>", "Title\n{a}"),
    ("<article><header><h1>Title</h1></header><p>{a}</p><div class='related-work'><h2>Related work</h2><p>{a}</p></div></article>", "Title\n{a}\nRelated work\n{a}"),
    ("<article><h1>T</h1><section><h2>A</h2><p>{a}</p><p>{a}</p></section><section><h2>B</h2><p>{a}</p></section><section><p>End.</p></section></article>", "T\nA\n{a}\n{a}\nB\n{a}\nEnd."),
    ("<h1>Title</h1><div class=content><p>{a}</p><p>{a}</p></div><div class='site-footer'>f</div>", "Title\n{a}\n{a}"),
    ("<div class='layout has-sidebar'><p>{a}</p><p>{a}</p></div><div class='cookie-banner'>We use cookies</div>", "{a}\n{a}"),
    ("<form id=aspnet><article><p>{a}</p></article></form><div class='ad-slot'><p>{a}</p></div>", "{a}"),
    ("<div class=comments><p>{a}</p></div>", "{a}"),
    ("<head><title>x</title><meta a=b><body><p>{a}</p>", "{a}"),
    ("<head><title>x</title><p>{a}</p>", "{a}"),
    ("<p>{a} <b>1 < 2</b> & <3 <i class='x>y'>z</i></p>", "{a} 1 < 2 & <3 z"),
    ("<p>{a}</p><p title='open>rest {a}</p>", "{a}\nrest {a}"),
])
def test_html_keeps_the_article(page, text):
    assert html_density.main_text(page.format(a=ARTICLE)) == text.format(a=ARTICLE)


def test_html_measures_like_brute_force():
    """Characters, tags, densities and sums of every node of random pages, each counted anew from the page's own tree."""
    import math
    import random

    rnd = random.Random(4)

    def page(depth):
        tag = rnd.choice(["div", "a", "span", "section"])
        return f"<{tag}>" + "".join(rnd.choice(["text ", "x", page(depth - 1) if depth else "end"]) for _ in range(rnd.randrange(1, 5))) + f"</{tag}>"

    def below(n):
        return [x for k in n.kids if not isinstance(k, str) for x in (k, *below(k))]

    def chars(n):
        return sum(len(" ".join(k.split())) if isinstance(k, str) else chars(k) for k in n.kids)

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(link_chars(k) for k in n.kids if not isinstance(k, str))

    for _ in range(40):
        root = html_density.parse("".join(page(3) for _ in range(4)))
        html_density._measure(root)

        def density(n):
            c, t, lc, lt = chars(n), max(1, len(below(n))), max(1, link_chars(n)), max(1, sum(x.tag == "a" for x in below(n)))
            if not c:
                return 0.0
            base = math.e + c / max(1, c - link_chars(n)) * lc + link_chars(root) / chars(root) * c
            return c / t * max(0.0, math.log(c * t / lc / lt)) / math.log(math.log(base))

        for n in [root, *below(root)]:
            assert (n.chars, n.tags, n.link_chars) == (chars(n), len(below(n)), link_chars(n))
            assert math.isclose(n.density, density(n)) and math.isclose(n.sum, sum(density(k) for k in n.kids if not isinstance(k, str)))


def test_html_takes_time_in_proportion():
    import time

    cases = [lambda n: "<a " * n, lambda n: '<a "' * n, lambda n: "<!" * n, lambda n: "<div>" * n + "x", lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "</p>" * n]
    for f in cases:
        began = time.process_time()
        html_density.main_text(f(60_000))
        assert time.process_time() - began < 10, f(2)


def test_html_frame(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_density.extract(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_density.extract(pages.limit(0)).count() == 0
    # repeated rows and clashing names; the article is what stands between its tags
    twice = pages.union(pages).withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    again = html_density.extract(twice).collect()
    assert Counter((r["page_id"], r["text"]) for r in again) == Counter({(r["page_id"], r["text"]): 2 for r in got})
    plain = lambda h: " ".join(html_density.html.unescape(re.sub(r"<[^>]*>", " ", h[h.index("<article>"):h.index("</article>")])).split())
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert all(" ".join(r["text"].split()) == want[r["page_id"]] for r in got)


# 3 -------------------------------------------------------------------------------------------
def brute_lines(rows):
    key = lambda x: x.strip(SP).translate({c: c + 32 for c in range(65, 91)})
    ids = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                ids[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(ids.get(key(x), ())) < 2 or min(ids[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(any_docs):
    got = line_dedup.line_dedup(any_docs).select("doc_id", "__l_lines", "__l_dropped", "__l_kept").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_lines(texts(any_docs))
    assert line_dedup.without_repeats(any_docs).columns == any_docs.columns


def test_filters_miss_no_repeat(spark, monkeypatch):
    """Whatever way pairs are dealt to tasks, each hash of two documents is a suspect, and few others are, unless the filter is full."""
    import numpy as np

    rng = np.random.default_rng(2)
    alone, shared = rng.integers(-(1 << 62), 1 << 62, 20_000), rng.integers(-(1 << 62), 1 << 62, 500)
    rows = [(i % 900, int(h), 0) for i, h in enumerate(alone)] + [(int(i), int(h), 0) for h in shared for i in rng.choice(900, 2, replace=False)] + [(i, 77, 0) for i in range(900)] + [(5, 78, 0)] * 3
    rng.shuffle(rows)
    d = spark.createDataFrame([tuple(map(int, r)) for r in rows], "id long, hi long, lo long").repartition(7)
    got = Counter((r["id"], r["hi"]) for r in line_dedup.suspects(d).collect())
    want = {(int(i), int(h)) for i, h, _ in rows if h in {77, *shared.tolist()}}
    assert want <= set(got) and len(set(got) - want) < 0.1 * len(alone)
    monkeypatch.setattr(line_dedup, "MERGED", 200)  # salts, and a second step
    assert Counter((r["id"], r["hi"]) for r in line_dedup.suspects(d).collect()) == got
    monkeypatch.setattr(line_dedup, "MOST_BITS", 14)
    assert want <= {(r["id"], r["hi"]) for r in line_dedup.suspects(d).collect()}


def test_line_dedup_holds_little():
    """What a worker gathers does not grow with a batch: 300,000 lines, of which every second document loses all."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def halves(line):
        h = xxhash.xxh3_128_intdigest(line)
        return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)

    def most(batches, see):
        tracemalloc.start()
        try:
            for b in batches:
                see(b)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    texts = ["\n".join(f"line {i} {j} of all" for j in range(300)) for i in range(1000)]
    gone = [None if i % 2 else [halves(x.encode()) for x in t.split("\n")] for i, t in enumerate(texts)]
    want = {(i, *halves(x.encode())) for i, t in enumerate(texts[::100]) for x in t.split("\n")}
    ids, got, sizes, kept = pa.array(range(1000), pa.int64()), set(), [], []

    def pairs_seen(b):
        sizes.append(b.num_rows)
        i = b.column(0).to_numpy()
        for x in np.flatnonzero(i % 100 == 0):
            got.add((int(i[x]) // 100, b.column(1)[x].as_py(), b.column(2)[x].as_py()))

    assert most(line_dedup._pairs(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["doc_id", "text"])])), pairs_seen) < 12e6
    assert got == want and sum(sizes) == 300_000 and max(sizes) <= line_dedup.HELD + 300

    digests = pa.array([g and [{"hi": x, "lo": y} for x, y in g] for g in gone], pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64())])))
    b = pa.RecordBatch.from_arrays([ids, pa.array(texts), digests], ["doc_id", "__l_text", "__l_gone"])
    assert most(line_dedup._apply(iter([b])), lambda b: kept.append(b)) < 16e6
    assert [tuple(r.values()) for b in kept for r in b.to_pylist()] == [(i, t if i % 2 else "", 300, 0 if i % 2 else 300) for i, t in enumerate(texts)]

    f = line_dedup.Filters(20)
    f.add(np.arange(5000), np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    segments = [(b.num_rows, b.column("segment")[0].as_py()) for b in f.parts()]
    assert segments == [(1, k) for k in sorted({k for _, k in segments})] and segments and not f.once


# 4 -------------------------------------------------------------------------------------------
def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    nodes = sorted(set(fps))
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return root


def test_simhash(any_docs):
    rows = [(i, brute_fp(t)) for i, t in texts(any_docs)]
    root = brute_groups([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[root(f)] = min(i, first.get(root(f), i))
    got = simhash.near_groups(any_docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((str(i), f, first.get(root(f))) for i, f in rows)
    kept = simhash.one_of_each(any_docs)
    assert kept.columns == any_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, first.values()), *("None" for i, _ in rows if i is None)])


def test_trie_join_links_all(spark):
    import random

    rnd = random.Random(1)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.randrange(6)):
            for _ in range(rnd.randrange(3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r["node"] & (1 << 64) - 1: r["component"] for r in simhash.connected_components(simhash.links(spark.createDataFrame(signed, "fp long")), "a", "b").collect()}
    root = brute_groups(list(fps))
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[got.get(f, f)].add(f)
        want[root(f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_copies(any_docs):
    """Against all pairs; a copy with one word in 80 changed counts, an unlike text does not."""
    import numpy as np

    words = [f"w{i}" for i in range(80)]
    edited = [" ".join(words[:k] + ["new"] + words[k + 1:]) for k in (20, 50)]
    other = " ".join(words[:20] + [f"z{i}" for i in range(60)])
    spark = any_docs.sparkSession
    more = spark.createDataFrame([(9001, " ".join(words)), (9002, edited[0]), (9003, edited[1].upper()), (9004, other)], "doc_id long, text string")
    d = any_docs.unionByName(more, allowMissingColumns=True)
    rows = [(i, near_copies.shingle_set(t)) for i, t in texts(d)]
    sets, parent = {x.tobytes(): x for _, x in rows}, {x.tobytes(): x.tobytes() for _, x in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1:]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    first = {}
    for i, x in rows:
        if i is not None:
            first[root(x.tobytes())] = min(i, first.get(root(x.tobytes()), i))
    got = near_copies.near_groups(d).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(i), first.get(root(x.tobytes()))) for i, x in rows)
    assert {9001, 9004} <= (ids := {r["component_id"] for r in got}) and not {9002, 9003} & ids
    assert {9002, 9003} <= {r["component_id"] for r in simhash.near_groups(d).collect()}  # the 2-bit rule has them all stay


def test_near_copies_beyond_the_hub(spark):
    """A chain: neighbours are near, ends are not, and the bucket's least node need not be near to all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([f"v{i}x{k}" if k < 20 * i else w for k, w in enumerate(words)])) for i in range(1, 7)]
    rows += [(10 + i, " ".join(words[30 * i:300 + 30 * i])) for i in range(4)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[10 + i] for i in range(4)} == {10}
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in rows}
    assert all(got[a] == got[b] for a in sets for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def test_near_copies_of_any_length(spark):
    """Pairs just above and well below the threshold, from 40 to 9,000 words: all of the former link, none of the latter."""
    import random

    rnd = random.Random(12)
    rows, want = [], {}
    for k, n in enumerate([40, 90, 400, 1000, 1100, 2100, 2500, 9000] * 3):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for j, share in enumerate((0.105, 0.40)):  # of the shingles of each side, what the other lacks: 0.8 is reached at a ninth
            other = words[:n - int(n * share)] + [f"v{rnd.randrange(10**6)}" for _ in range(int(n * share) - 4 * (j == 0))]
            a, b = (set(near_copies.shingle_set(" ".join(x)).tolist()) for x in (words, other))
            rows += [(100 * k + 2 * j, f"{' '.join(words)} e{j} e{j}"), (100 * k + 2 * j + 1, f"{' '.join(other)} e{j} e{j}")] if j else [(100 * k, " ".join(words)), (100 * k + 1, " ".join(other))]
            want[100 * k + 2 * j] = len(a & b) / len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in rows}
    for i in want:
        near = 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])
        assert (got[i] == got[i + 1]) == near, (i, want[i])


def test_wide_fingerprint():
    """A bit is 1 if set in over half of the widened hashes; texts of a similarity of 0.8 differ in about 0.15 of the bits, unlike ones in half."""
    import numpy as np

    top, odd = (1 << 64) - 1, [int(x) for x in near_copies.ODD]
    found = near_copies.shingle_set(" ".join(f"w{i}" for i in range(700)))
    set_in = Counter()
    for h in found.tolist():
        for k in range(near_copies.BITS // 64):
            x = h * odd[k] & top
            x = (x ^ x >> 29) * odd[near_copies.BITS // 64] & top
            set_in.update(64 * k + b for b in range(64) if (x ^ x >> 32) >> b & 1)
    got = near_copies.fingerprint(found).view(np.uint64).tolist()
    assert [got[b // 64] >> b % 64 & 1 for b in range(near_copies.BITS)] == [2 * set_in[b] > len(found) for b in range(near_copies.BITS)]
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 2000, np.uint64)
    a, b, c = (near_copies.fingerprint(x).view(np.uint64) for x in (hashes[:900], hashes[100:1000], hashes[1100:]))
    assert 45 < np.bitwise_count(a ^ b).sum() < 110 and np.bitwise_count(a ^ c).sum() > 200


@pytest.mark.parametrize("slots, shared, tables, width", [(4, 0, 3, 9), (6, 2, 3, 9)])
def test_near_copies_trie_join(spark, slots, shared, tables, width):
    """The tries find what all pairs of fingerprints hold: within the budget in a table's bits and in all; each pair once, and a forest that joins the same."""
    from functools import partial

    import numpy as np

    rnd = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = rnd.integers(0, 1 << 62, 60, np.uint64)
        sets += [np.unique(np.r_[base[k:], rnd.integers(0, 1 << 62, k, np.uint64)]) for k in rnd.integers(0, 25, 5).tolist()]
    fps = [near_copies.fingerprint(x) for x in sets]
    nodes = spark.createDataFrame([(i, f.tolist(), near_copies.sketch(x).tolist()) for i, (f, x) in enumerate(zip(fps, sets))], "node long, fp array<long>, sketch array<long>")
    bits = np.unpackbits(np.array(fps).view(np.uint8), axis=1, bitorder="little")
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            differ = bits[i] != bits[j]
            near = differ.sum() <= near_copies.SPAN and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
            met = lambda s, t: not differ[near_copies._order(s)[:shared]].any() and differ[near_copies._positions(s, t, shared, width)].sum() <= near_copies.BUDGET
            if near and any(met(s, t) for s in range(slots) for t in range(tables)):
                want.add((i, j))
    given = near_copies.dealt(nodes.withColumn("size", F.get("sketch", F.lit(1))).select("node", "fp", "size"), slots, shared)
    run = lambda forest: [tuple(r) for r in given.mapInArrow(partial(near_copies._pairs, shared=shared, tables=tables, width=width, forest=forest), "a long, b long").collect()]
    got, few = run(False), run(True)
    assert sorted(got) == sorted(want) and len(want) > 200
    assert set(few) <= want and {x for pair in few for x in pair} == {x for pair in want for x in pair}
    join = lambda pairs: sorted(simhash.forest(*np.array(sorted(pairs)).T))
    assert join(few) == join(want)


def test_near_copies_plan():
    """Pairs of a similarity of 0.8 are in some table but for one in a million, whatever the number of fingerprints."""
    for n in (0, 1, 300, 50_000, 3_000_000, 20_000_000):
        slots, shared, tables, width = near_copies.plan(n)
        assert near_copies.missed(slots, shared, tables, width) <= 1e-6 and n >> shared <= near_copies.DEALT and n <= 1 << width


def test_near_dedup_stage(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(words[:40] + ["new"] + words[41:]), "en", "a", 1), (3, "quite another text", "en", "a", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, d, "")
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


# 5 -------------------------------------------------------------------------------------------
def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(SP)]
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    c, cover = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality(any_docs):
    got = quality.quality_rules(any_docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *brute_quality(t)) for i, t in texts(any_docs))
    assert not any(r["base_failed"] and r["kept"] for r in got)
    kept = quality.keep_good(any_docs)
    assert kept.columns == any_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_quality_verdict(real, spark):
    odd = [(10**6, " ".join(f"#{i}$$ %%{i}& **|" for i in range(200)), "en"), (10**6 + 1, " ".join(f"QXJZ{i}KW" for i in range(300)), "en")]
    d = real.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in quality.quality_rules(d).collect()}
    assert not got[10**6]["kept"] and not got[10**6 + 1]["kept"]


def test_quality_words_judge(real, spark):
    """A long text of plain words, none of them common, is far; so it is for a label that only its own documents describe."""
    import random

    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abdefgiklmnoprstu") for _ in range(rnd.randrange(4, 9))) for _ in range(400)]
    function = [f"{a}{b}" for a in "qxzwj" for b in "aeiou"]
    plain = lambda: " ".join(rnd.choice(vocabulary) for _ in range(300)) + "."
    own = lambda: " ".join(rnd.choice(function if rnd.random() < 0.3 else vocabulary) for _ in range(300)) + "."
    odd = [(10**6, plain(), "en"), (10**6 + 1, plain(), None), (10**6 + 2, plain(), "zz"), (10**6 + 3, "".join(f"#{i}$$ %%{i}& **| " for i in range(200)), "zz"), *((2 * 10**6 + i, own(), "zz") for i in range(40))]
    d = real.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(d).collect()}
    assert not any(got[10**6 + i] for i in range(4)) and all(got[2 * 10**6 + i] for i in range(40))
    assert {r["doc_id"] for r in quality.keep_good(d).collect()} == {i for i, kept in got.items() if kept}


def test_quality_references(real, spark):
    """Repetitive junk is no part of a reference, and common words count in any case."""
    d = real.select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10**6 + i, "zq! " * 300, "en") for i in range(100)], "doc_id long, text string, lang string")
    refs = [quality.references(quality.stash(quality.features(x).drop("text"), "features")) for x in (d, d.union(junk))]
    assert refs[0] == refs[1] and refs[0]
    case = lambda f: {r["doc_id"]: r["word_distance"] for r in quality.quality_rules(d.filter("lang = 'en'").union(d.filter("lang = 'de'").select("doc_id", f("text"), "lang"))).collect()}
    assert case(F.upper) == case(F.lower)


def test_quality_distances(real, docs):
    """Both distances and the verdict of every document with listed words or no label, counted anew."""
    import math

    d = real.select("doc_id", "text", "lang").union(docs.filter("doc_id is not null and lang in ('en', 'fr')").select(F.col("doc_id") + 10**6, "text", "lang")).union(real.limit(20).select(F.col("doc_id") + 2 * 10**6, "text", F.lit(None).cast("string")))
    rows = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in d.collect()}
    listed = set(quality.BINS)

    def core(w):
        return (w.strip(quality.EDGES) if len(w.strip(quality.EDGES)) >= len(w) - 1 else w).lower()

    def measures(t):
        w, n_symbols, *_ = brute_quality(t)[0], brute_quality(t)[2]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = lambda p: len(re.findall(p, t))
        c = {"accented": count(r"[^\x00-\x7F]"), "upper": count("[A-Z]"), "digit": count("[0-9]"), "space": len(t) - sum(map(len, words)), "punct": count(r"""[.,;:!?'"()\[\]/_=+@-]"""), "symbol": n_symbols}
        c["letter"] = max(0, len(t) - sum(c.values()))
        return w, [c[k] for k in quality.CLASSES], Counter(x for x in map(core, words) if x in listed)

    got = {i: measures(t) for i, (t, _) in rows.items()}
    failed = {i: brute_quality(t)[5] for i, (t, _) in rows.items()}
    refs = {}
    for lang in quality.COMMON:
        own = [got[i] for i, (_, x) in rows.items() if x == lang and not failed[i]]
        if not own:
            continue
        chars, n = [sum(c[k] for _, c, _ in own) for k in range(len(quality.CLASSES))], sum(w for w, *_ in own)
        words = sum((h for *_, h in own), Counter())
        refs[lang] = [c / sum(chars) for c in chars], [words[b] / n for b in quality.BINS]

    def distance(p, q):
        part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    rest = lambda x: [*x, 1 - sum(x)]
    for r in quality.quality_rules(d).collect():
        (t, lang), (w, c, h) = rows[r["doc_id"]], got[r["doc_id"]]
        chars = [distance([x / max(1, len(t)) for x in c], q) for q, _ in refs.values()]
        far = [distance(rest([h[b] / max(1, w) for b in quality.BINS]), rest(q)) for _, q in refs.values()]
        share = min(x / distance(rest([0.0] * len(q)), rest(q)) for x, (_, q) in zip(far, refs.values()))
        assert lang in refs or lang is None
        assert abs(r["char_distance"] - min(chars)) < 1e-4 and abs(r["word_distance"] - min(far)) < 1e-3
        is_far = len(t) >= quality.MIN_CHARS and min(chars) > quality.MAX_CHAR_DISTANCE or w >= quality.MIN_HIST_WORDS and share > quality.MAX_WORD_SHARE
        assert r["kept"] == (not failed[r["doc_id"]] and not is_far) or abs(min(chars) - quality.MAX_CHAR_DISTANCE) < 1e-4 or abs(share - quality.MAX_WORD_SHARE) < 1e-3


# 6 -------------------------------------------------------------------------------------------
def brute_imatch(rows):
    """(fingerprint, edited fingerprint, likeness to it, likeness to the next) for rows in their order: terms, tiers and fields made anew."""
    import struct

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    unsigned = lambda x: x & (1 << 64) - 1
    number = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<q", x), unsigned(seed))
    term = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    terms = lambda t: {term(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())}
    df = Counter(x for _, t in rows for x in terms(t))
    lex = {x for x, n in df.items() if max(2.0, imatch.MIN_SHARE * len(rows)) <= n <= imatch.MAX_SHARE * len(rows)}

    def fold(xs):
        h = 42
        for x in xs:
            h = number(x, h)
        return f"{h:016x}"[:4]

    def print_of(t):
        own = sorted(terms(t) & lex)
        trials = [[signed(xxhash.xxh64_intdigest(struct.pack("<i", i), number(x, 42))) for x in own] for i in range(imatch.TRIALS)]
        fields = []
        for r in range(1, imatch.TIERS + 1):
            for hs in trials:
                some = [h for h in hs if h % (1 << r) == 0]
                fields.append(fold(some) if some else "----")
        return "".join(fields) + (fold(own) if own else f"{xxhash.xxh64_intdigest(t.encode(), 42):016x}"[:4])

    def alike(a, b):
        if a == b:
            return 1.0
        n = imatch.TIERS * imatch.TRIALS
        x, y = ([p[4 * i:4 * i + 4] for i in range(n)] for p in (a, b))
        first = min((f.index("----") for f in (x, y) if "----" in f), default=n - 1) // imatch.TRIALS * imatch.TRIALS
        pairs = [(p, q) for p, q in zip(x[first:], y[first:]) if p != "----" or q != "----"]
        return sum(p == q for p, q in pairs) / len(pairs) if pairs else float(a[-4:] == b[-4:])

    edited = [t[:len(t) - len(t) // 3] + rows[(k + 1) % len(rows)][1][:len(t) // 3] for k, (_, t) in enumerate(rows)]
    prints = [print_of(t) for _, t in rows]
    more = [print_of(t) for t in edited]
    return [(p, e, alike(p, e), alike(p, prints[(k + 1) % len(rows)])) for k, (p, e) in enumerate(zip(prints, more))]


def test_imatch_fingerprints(spark, tmp_path, real, monkeypatch):
    d = real.select("doc_id", "text").limit(60).union(spark.createDataFrame([(5000, None), (5001, ""), (5002, "zz yy"), (5003, "zz yy"), (5004, "The THE the of")], "doc_id long, text string"))
    d.write.parquet(f"{tmp_path}/some/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in d.collect()), reverse=True)
    want = dict(zip((i for i, _ in rows), brute_imatch(rows)))
    for most in (imatch.MAX_LISTED_TERMS, 0):  # the lexicon listed, and joined
        monkeypatch.setattr(imatch, "MAX_LISTED_TERMS", most)
        for r in imatch.op6_imatch(spark, f"{tmp_path}/some").collect():
            p, e, a, b = want[r["doc_id"]]
            assert (r["fingerprint"], r["edited_fingerprint"]) == (p, e)
            assert abs(r["near_edited"] - a) < 1e-9 and abs(r["near_next"] - b) < 1e-9


def test_imatch(spark, sf_dir, tmp_path, real, docs):
    both = docs.select("doc_id", "text").union(real.select(F.col("doc_id") + 1000, "text"))
    for name, d in (("real", both), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [r for r in imatch.op6_imatch(spark, f"{tmp_path}/{name}").collect()]
        rows = sorted(((i, t or "") for i, t in texts(d)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        want = []
        for k, (i, t) in enumerate(rows):
            n, m = len(t), len(t) // 3
            want.append((str(i), n, hashlib.sha256((t[:n - m] + rows[(k + 1) % len(rows)][1][:m]).encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        by_id = {i: t for i, t in rows}
        same = defaultdict(set)
        for r in got:
            same[by_id[r["doc_id"]]].add(r["fingerprint"])
        assert all(len(x) == 1 for x in same.values())
        if name == "real":
            long = [r for r in got if r["n_chars"] > 300 and (r["doc_id"] or 0) >= 1000]
            assert sum(r["near_edited"] for r in long) / len(long) > 0.25 > 0.1 > sum(r["near_next"] for r in long) / len(long)


def test_ranges_keep_order(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    d = spark.createDataFrame([(i * i % 997 if i % 50 else None, str(i)) for i in range(500)], "doc_id long, text string")
    rows = imatch.with_next(d.withColumn("__f_range", imatch.ranges(d)), [F.col("doc_id").desc_nulls_last(), F.col("text").desc()], {"text": "next"}).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    after = {want[k]: want[(k + 1) % len(want)][1] for k in range(len(want))}
    assert len({r["__f_range"] for r in rows}) > 20 and all(after[r["doc_id"], r["text"]] == r["next"] for r in rows)


# 7 -------------------------------------------------------------------------------------------
def test_packing(any_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for i, t in texts(any_docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[str(i), k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    got = packing.packed(any_docs).collect()
    assert Counter((str(r["doc_id"]), *(r[c] for c in ("piece", "start", "length", "ids_crc32"))) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) * 1.02 + 1


def test_chunks_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(packing.vocabulary_path()), packing.vocabulary_path()
    odd = ["It's ÉTÉ́ x y  z\x1cq <|endoftext|> a<|startoftext|>b 12 3٣ 'S don't", "́ a ́b", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "日本語テキスト 😀😀 ...!!!", "\x85x​y", "İstanbul ﬁ"]
    for t, got in zip(odd, packing.encode(odd, path)):
        assert got == b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t, add_special_tokens=False).ids, 0]), t


def test_local_search_empties_a_bin():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]
    bins = packing.local_search([[0, 4], [1, 5], [2, 6], [3, 7]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(8)) and all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_search_against_the_optimum():
    """Small groups: seldom more bins than the fewest that exist, found by trying all; large ones: the search empties bins of the first fill."""
    import random

    def fewest(lengths, capacity):
        best = len(lengths)

        def put(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(lengths):
                best = len(rooms)
                return
            for i, r in enumerate(rooms):
                if r >= lengths[k] and r not in rooms[:i]:
                    put(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1:]])
            put(k + 1, [*rooms, capacity - lengths[k]])

        put(0, [])
        return best

    rnd = random.Random(8)
    over = []
    for _ in range(60):
        lengths = [rnd.randrange(2, 14) for _ in range(9)]
        placed, (_, after, _) = packing.pack_group(lengths, 20)
        assert len({b for b, _ in placed}) == after
        over.append(after - fewest(sorted(lengths, reverse=True), 20))
    assert min(over) >= 0 and max(over) <= 1 and sum(over) <= 3
    for lo, hi, most in ((200, 1200, 1.005), (400, 1000, 1.015)):
        _, (before, after, least) = packing.pack_group([rnd.randrange(lo, hi) for _ in range(3000)])
        assert after < before and after <= most * least


# 8 -------------------------------------------------------------------------------------------
def test_mixing(any_docs):
    got = mixing.poisson_mix(any_docs)
    assert mixing.mixed(any_docs).columns == any_docs.columns
    rows = got.select("doc_id", "source", "text", "__m_copies", "__m_copy").collect()
    each = defaultdict(list)
    for r in rows:
        each[r["doc_id"], r["source"], r["text"]].append((r["__m_copies"], r["__m_copy"]))
    assert all(set(x) == {(x[0][0], k) for k in range(1, x[0][0] + 1)} for x in each.values())


def test_mixing_hits_targets(spark):
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.poisson_mix(d, {"small": 3, "large": 1}, budget=40000).groupBy("source").count().collect()}
    assert abs(n["small"] - 30000) < 700 and abs(n["large"] - 10000) < 400
    far = mixing.poisson_mix(d.filter("source = 'small'").limit(5), {"small": 1}, budget=5000).count()  # rate 1000
    assert abs(far - 5000) < 400


# 9 -------------------------------------------------------------------------------------------
def test_language(docs, real, spark):
    model = language.train(real.filter(~language.held_out()))
    held = language.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 10, 13)) and got[12]["lang_pred"] != "und"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values())
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"} and language.predict(docs.limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    m = language.Model(["a", "b", "c"], np.vstack([rng.normal(size=(language.BUCKETS, 3)), np.zeros((1, 3))]).astype(np.float32), np.zeros((3, len(language.SCRIPTS)), bool))
    docs = [["one", "two", "three", "four"], [], ["five"], ["two", "one", "six"]]
    for words, path in zip(docs, m.label(docs)):
        value = lambda p, words=words: sum(m.scores[m.known[w], k] for w, k in zip(words, p)) - language.PENALTY * sum(x != y for x, y in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(words))), default=0)
        assert abs(value(path.tolist()) - best) < 1e-4


def test_word_scores_sum_their_grams(monkeypatch):
    """Each word's row is the sum over its n-grams and itself, whatever words are scored along with it, and with a cache that never lasts."""
    import numpy as np

    words = ["a", "éa", "aaaa", "straße", "мир", "x" * 40, "ab", "ba"]
    found = [sorted(int(g) for gs in language.Words([w]).grams() for g in gs if g < language.BUCKETS) for w in words]
    assert [len(g) for g in found] == [1 + sum(max(0, len(w) + 2 - n + 1) for n in range(1, language.LONGEST + 1)) for w in words]
    assert found[-1] != found[-2]
    together = [sorted(x) for x in zip(*(gs.tolist() for gs in language.Words(words).grams()))]
    assert len(together) == sum(len(w) + 2 for w in words)
    weights = np.vstack([np.random.default_rng(1).normal(size=(language.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32)
    m = language.Model(["p", "q"], weights, np.zeros((2, len(language.SCRIPTS)), bool))
    want = np.array([weights[g].sum(axis=0) for g in found]) * (2.0 / language.LONGEST)
    want -= want.max(axis=1, keepdims=True)
    assert np.allclose(m.score(words), want, atol=1e-3)
    once = m.predict([words, words[:2]])
    monkeypatch.setattr(language, "CACHE", 0)
    assert m.predict([words, words[:2]]) == once == [*m.predict([words]), *m.predict([words[:2]])]


def test_language_learns_every_label(spark):
    import random

    rnd = random.Random(9)
    kinds = {f"l{k:03d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(230)}
    rows = [(i * 230 + k, " ".join(rnd.choice(kinds[x]) for _ in range(25)), x) for i in range(4) for k, x in enumerate(sorted(kinds))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d)
    assert len(model.langs) == 230
    got = language.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


# 10 ------------------------------------------------------------------------------------------
def test_sharding(any_docs):
    rows = texts(any_docs)
    got = sharding.shard(any_docs).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, crc(t)) for i, t in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in groups.values())
    assert all(0 <= s < 40 for s in slots)


def test_differencing_is_tight():
    import random

    rnd = random.Random(3)
    sizes = [int(rnd.lognormvariate(7, 1)) for _ in range(3000)]
    sums = [0] * 40
    for n, k in zip(sizes, sharding.differencing(sizes)):
        sums[k] += n
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 0.001 * sum(sizes) / 40
    giant = sharding.differencing([10**6, *[100] * 390])
    assert Counter(giant)[giant[0]] == 1


def test_shards_stay_even_when_bundled(real, monkeypatch):
    """Bytes of shards, with most groups dealt in bundles: within a bundle of the mean, and equal to differencing by hand."""
    monkeypatch.setattr(sharding, "LARGE", 50)
    monkeypatch.setattr(sharding, "BUNDLES", 60)
    rows = sharding.shard(real, shards=4).collect()
    total, sums = sum(r["size"] for r in rows), Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= total / 4 * 0.02


# pipeline ------------------------------------------------------------------------------------
CLASH = ["__l_text", "__l_kept", "__q_words", "__q_kept", "__q_row", "__m_key", "__m_copies", "__f_range", "__p_row", "row", "id", "node", "fp", "component_id", "u", "hi", "lo", "gone", "owner"]


@pytest.fixture(params=["rows", "none"])
def clashing(request, spark, docs, real):
    """The odd rows, repeats of them and real ones under the columns of documents, with columns that are named like those the operators make."""
    odd = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    d = odd.union(odd.filter("doc_id in (1, 8)")).union(real.select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars")).withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})
    return d if request.param == "rows" else d.limit(0)


def test_stages_on_odd_tables(spark, clashing):
    import corpus_pipeline

    have = Counter((r["doc_id"], r["text"]) for r in clashing.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert all(tuple(r[c] for c in CLASH) == tuple(range(len(CLASH))) for r in rows), name
        if name != "line_dedup":
            assert all((r["doc_id"], r["text"]) in have for r in rows), name
    assert len(rows) == 0 if not have else len(rows) > 0
    d = clashing
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
    assert set(d.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and (d.count() > 0) == bool(have)


def test_operators_on_clashing_columns(clashing):
    """The operators see doc_id and text alone: other columns change no result."""
    plain = clashing.select("doc_id", "text", "lang", "source")
    for f in (lambda d: pii.find_pii(d), lambda d: simhash.near_groups(d), lambda d: quality.quality_rules(d), lambda d: packing.pieces(d), lambda d: sharding.shard(d).select("doc_id", "size", "shard")):
        assert Counter(map(str, f(clashing).collect())) == Counter(map(str, f(plain).collect()))


def test_pipeline(spark, sf_dir, real):
    import corpus_pipeline

    names = [f.__name__ for _, f in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup_stage", "near_dedup", "mix_sources", "pack_sequences"]
    docs = {r["doc_id"]: r for r in real.collect()}
    good = {r["doc_id"] for r in quality.quality_rules(real).collect() if r["kept"]}
    lines = {int(i): t for i, _, _, t in brute_lines([(i, docs[i]["text"]) for i in good])}
    fps = {i: brute_fp(t) for i, t in lines.items()}
    root, first = brute_groups(list(fps.values())), {}
    for i in sorted(fps):
        first.setdefault(root(fps[i]), i)
    kept = set(first.values())
    d = spark.createDataFrame([(i, lines[i], docs[i]["lang"], docs[i]["source"], len(lines[i])) for i in kept], real.schema)
    want = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.pieces(mixing.mixed(d)).collect())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want and want
