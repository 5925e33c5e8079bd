"""Queries that once left out rows of their job, against brute force."""

import hashlib

import numpy as np

from larkspur.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
KEYS = {"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"}


def plain_address(url):
    url = url.split("#")[0]
    scheme, _, rest = url.partition("://")
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path, _, search = path.partition("?")
    kept = [p for p in search.split("&") if p and not ("=" in p and p.split("=")[0].lower() in KEYS)]
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    return f"{scheme.lower()}://{host.lower()}{path}" + ("?" + "&".join(kept) if kept else "")


def test_every_url_is_normalised(spark, tmp_path):
    urls = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()]
    urls += [(10**9 + k, u) for k, u in enumerate((
        "HTTP://A.example/B?utm_source=x", "https://a.example/?UTM_Medium=x&utm_term=y&b=1#top", "https://a.example/p?b=1&utm_content=&c=2", "https://a.example?utm_campaign=z", "https://a.example/p?utm_other=1",
    ))]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["address"], r["identity"]) for r in QUERIES["url_normalize_all"](spark, str(tmp_path)).collect()}
    assert got == {k: (plain_address(u), hashlib.sha256(plain_address(u).encode()).hexdigest()) for k, u in urls}


def test_neighbours_of_any_label_and_id(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x, label = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64), {r["vec_id"]: r["label"] for r in rows}
    want = {(int(a), int(b)) for a, v in zip(ids, x) if a % 20 == 0 for b in ids[np.sqrt(((x - v) ** 2).sum(1)) <= 6.0] if a != b}
    got = [(r["vec_id"], r["other_id"]) for r in QUERIES["vector_neighbours_all"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(label[a] != label[b] for a, b in got) and any(a > b for a, b in got)
