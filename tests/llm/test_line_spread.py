"""Line spread against plain counting, and the defined cases."""

import random

from gapspark.llm import line_spread


def sites_of(rows):
    sites = {}
    for _, text, site in rows:
        for line in set((text or "").split("\n")):
            if line.strip(" ") and site is not None:
                sites.setdefault(line, set()).add(site)
    return sites


def expected(rows, min_sites, share=0.5):
    shared = {x for x, s in sites_of(rows).items() if len(s) >= min_sites}

    def witness(text):
        lines = (text or "").split("\n")
        return sum(len(x) for x in lines if x in shared) <= share * sum(map(len, lines))

    wide = {x for x, s in sites_of([r for r in rows if witness(r[1])]).items() if len(s) >= min_sites} & shared
    out = []
    for doc_id, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x not in wide]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_plain_counting(spark):
    rng = random.Random(2)
    common = [f"shared footer {i}" for i in range(6)]
    rows = []
    for i in range(300):
        own = [f"line {i} {k} with its own words" for k in range(rng.randint(0, 6))] + ["", " "][: rng.randint(0, 2)]
        own += rng.sample(common, rng.randint(0, 4))
        rng.shuffle(own)
        rows.append((i, "\n".join(own), f"s{rng.randrange(8)}" if i % 17 else None))
    rows += [(None, None, None), (7, "shared footer 0", "s1"), (7, "shared footer 0", "s1"), (8, "", "s2")]
    rows.append((9, "shared footer 1\n" + "long text " * 20000, "s3"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (1, 4, 8, 9):
        out = line_spread.remove_widespread_lines(df, min_sites=least).collect()
        found = sorted(((r.doc_id, r.text, r.n_removed_lines) for r in out), key=str)
        assert found == expected(rows, least)


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", 5, 6)], "doc_id long, text string, source string, a int, n_removed_lines int")
    out = line_spread.remove_widespread_lines(df).collect()
    assert [tuple(r) for r in out] == [(1, "a\nb", "x", 5, 0)]
    assert line_spread.remove_widespread_lines(df.limit(0)).collect() == []


def test_pages_lose_their_frame_and_copies_stay(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    frame, twice, near = [line(4) for _ in range(4)], [line(12) for _ in range(4)], [line(12) for _ in range(12)]
    own = [line(20) for _ in range(12)]
    rows = [(i, "\n".join([*frame, own[i]]), f"s{i}") for i in range(12)]
    rows += [(15, "\n".join([*frame, "little"]), "s1"), (16, "\n".join(frame), "s2")]
    rows += [(20 + i, "\n".join(twice), f"s{i}") for i in range(12)]
    rows += [(40 + i, "\n".join([*near, f"copy number {i}"]), f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r.text, r.n_removed_lines) for r in line_spread.remove_widespread_lines(df).collect()}
    assert [out[i] for i in range(12)] == [(x, 4) for x in own] and out[15] == ("little", 4) and out[16] == ("", 4)
    assert all(out[i] == (t, 0) for i, t, _ in rows[14:])
    assert sorted(((i, *v) for i, v in out.items()), key=str) == expected(rows, 10)
