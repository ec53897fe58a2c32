"""The retrieval API: search, reading of bundles, status. Spark matches, ranks and fetches; at most 20 rows are fitted on the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.analyzer import folded, stem
from quernstone.functions.markdown import tokens
from quernstone.functions.snippets import safe_prefix, snippet
from quernstone.operators import search as ranking
from quernstone.plans import query as requests
from quernstone.plans.index import Index

MAX_TOKENS, MAX_BYTES, READ_TOKENS = 8000, 65_536, 800
PUBLIC = ("item_id", "scope", "title", "source_title", "source_path", "source_id", "locator", "locator_with_lines", "evidence_role", "provider", "session_id", "turn_index", "role", "heading_path", "occurrence", "part")


class RetrievalError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def encoded(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def counted(response: dict) -> dict:
    """The response with its own size in its usage: repeated until the number that it holds is the number that it has."""
    while True:
        n = tokens(encoded(response).decode())
        if response["usage"]["estimated_evidence_tokens"] == n:
            return response
        response["usage"]["estimated_evidence_tokens"] = n


def phrase_hits(found: DataFrame, phrase: str) -> DataFrame:
    """(item_id, field, f): adjacent single characters in one field, by equal joins on position."""
    out = None
    for k, ch in enumerate(phrase):
        one = found.where(F.col("term") == ch).select("item_id", "field", F.explode("positions").alias("p")).select("item_id", "field", (F.col("p") - k).alias("p"))
        out = one if out is None else out.join(one, ["item_id", "field", "p"])
    return out.groupBy("item_id", "field").agg(F.count(F.lit(1)).alias("tf"))


class Retrieval:
    def __init__(self, index: Index):
        self.index = index

    def scored(self, compiled: Sequence[requests.CompiledQuery]) -> DataFrame:
        """BM25 of all queries in one plan."""
        found = self.index.table("postings")
        spark, parts = self.index.spark, []
        rows = [(i, j, c.kind, c.value) for i, q in enumerate(compiled) for j, c in enumerate(q.clauses)]
        prefixes = {(i, j): stem(folded(v)) for i, j, k, v in rows if k == "prefix"}
        if prefixes:
            wanted = F.lit(False)
            for p in sorted(set(prefixes.values())):
                wanted = wanted | F.col("term").startswith(p)  # reaches the scan
            table = ranking.clause_table(spark, [[prefixes.get((i, j), "\x00") for j in range(len(q.clauses))] for i, q in enumerate(compiled)]).where("prefix <> '\\0'")
            parts.append(found.where(wanted).select("term", "item_id", "field", "tf").join(F.broadcast(table), F.col("term").startswith(F.col("prefix"))).select("query_ix", "clause_ix", "item_id", "field", "tf"))
        for i, j, kind, value in rows:
            if kind == "phrase":
                parts.append(phrase_hits(found, value).select(F.lit(i).alias("query_ix"), F.lit(j).alias("clause_ix"), "item_id", "field", F.col("tf")))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        markers = hits.select(F.concat(F.lit("\x01"), "query_ix", F.lit(":"), "clause_ix", F.lit(";")).alias("term"), "item_id", "field", "tf")
        clauses = ranking.clause_table(spark, [[f"\x01{i}:{j};" for j in range(len(q.clauses))] for i, q in enumerate(compiled)])
        return ranking.bm25_indexed(clauses, markers, self.index.table("lengths"))

    def search(self, queries: Sequence[object], scopes: Sequence[str] = requests.SCOPES, limit: int = requests.DEFAULT_RESULTS, max_tokens: int = MAX_TOKENS) -> dict:
        """The longest ranked prefix of results that fits the limits."""
        compiled, scopes, limit = requests.request(queries, scopes, limit)
        if isinstance(max_tokens, bool) or not isinstance(max_tokens, int) or not 1 <= max_tokens <= MAX_TOKENS:
            raise RetrievalError("invalid_request", f"1 to {MAX_TOKENS} tokens")
        ranked = ranking.top_candidates(self.scored(compiled), list(scopes)).select("query_ix", "item_id", "rank").collect()  # 20 a query at most
        if not ranked:
            return counted({"index_id": self.index.index_id, "results": [], "is_truncated": False, "usage": {"estimated_evidence_tokens": 0}})
        spark = self.index.spark
        fused = ranking.fuse(spark.createDataFrame(ranked), limit).collect()
        best: dict[str, tuple[int, int]] = {}
        for r in ranked:
            key = (0, 0) if r["query_ix"] == 0 else (r["rank"], r["query_ix"])
            best[r["item_id"]] = min(best.get(r["item_id"], (99, 99)), key)
        items = {r["item_id"]: r for r in self.items([r["item_id"] for r in fused])}
        results = []
        for r in sorted(fused, key=lambda r: r["final_rank"]):
            item = items.get(r["item_id"])
            if item is None:
                raise RetrievalError("index_damaged", "a ranked item is missing")
            text, before, after = snippet(item["body"], compiled[best[r["item_id"]][1]].anchors)
            results.append({"metadata": {k: item[k] for k in PUBLIC}, "bundle_key": item["bundle_key"], "rank": r["final_rank"], "snippet": text, "truncated_before": before, "truncated_after": after})
        for n in range(len(results), -1, -1):
            out = counted({"index_id": self.index.index_id, "results": results[:n], "is_truncated": n < len(results), "usage": {"estimated_evidence_tokens": 0}})
            if out["usage"]["estimated_evidence_tokens"] <= max_tokens and len(encoded(out)) <= MAX_BYTES:
                return out
        raise RetrievalError("budget_too_small", "not even an empty response fits")

    def items(self, ids: Sequence[str]) -> list:
        """A few items by id: their bundles are looked up first, by which the items are sorted."""
        places = self.index.table("seeds").where(F.col("item_id").isin(*ids)).collect()
        if not places:
            return []
        return self.index.table("items").where(F.col("bundle_key").isin(*sorted({p["bundle_key"] for p in places})) & F.col("item_id").isin(*ids)).collect()

    def read_item(self, item_id: str, index_id: str, max_tokens: int = READ_TOKENS) -> dict:
        """One item, cut at a safe place."""
        item = self._seed(item_id, index_id)
        text, cut = safe_prefix(item["body"], max_tokens)
        return {"metadata": {k: item[k] for k in PUBLIC}, "body": text, "is_truncated": cut}

    def _seed(self, item_id: str, index_id: str):
        if index_id != self.index.index_id:
            raise RetrievalError("index_mismatch", "the request names another index")
        found = self.items([item_id])
        if len(found) != 1:
            raise RetrievalError("item_not_found", "no such item")
        return found[0]

    def read_bundle(self, item_id: str, index_id: str, max_tokens: int = MAX_TOKENS) -> dict:
        """The seed's section: the seed first, then the nearest parts, as long as they fit; damage fails the whole read."""
        seed = self._seed(item_id, index_id)
        found = self.index.table("items").where((F.col("bundle_key") == seed["bundle_key"]) & (F.col("source_path") == seed["source_path"])).collect()  # one section or exchange
        members = sorted(found, key=lambda m: (m["role"] == "assistant", m["part"]))
        links = [m["item_id"] for m in members]
        for role in {m["role"] for m in members}:
            own = [m for m in members if m["role"] == role]
            ids, others = [m["item_id"] for m in own], [m["item_id"] for m in members if m["role"] != role]
            linked = all((m["relations"]["previous_part_id"], m["relations"]["next_part_id"], list(m["relations"]["counterpart_item_ids"])) == (p, n, others) for m, p, n in zip(own, [None, *ids[:-1]], [*ids[1:], None], strict=True))
            if not linked or [m["part"] for m in own] != list(range(1, len(own) + 1)) or role and len({m["role"] for m in members}) != 2:
                raise RetrievalError("bundle_damaged", "parts aren't complete and linked")
        at = links.index(item_id)
        order = [members[i] for i in sorted(range(len(members)), key=lambda i: (abs(i - at), -i))]
        chosen: list = []

        def response(rows: list) -> dict:
            ids = {r["item_id"] for r in rows}
            body = [{"metadata": {k: r[k] for k in PUBLIC}, "body": r["body"], "is_truncated": False} for r in sorted(rows, key=lambda r: links.index(r["item_id"]))]
            missing = [i for i in links if i not in ids]
            return counted({"seed_item_id": item_id, "bundle_key": seed["bundle_key"], "bundle_status": "partial_budget" if missing else "complete", "membership_complete": True, "missing_item_ids": missing, "items": body, "usage": {"estimated_evidence_tokens": 0}})

        out = None
        for m in order:
            new = response([*chosen, m])
            if new["usage"]["estimated_evidence_tokens"] > max_tokens or len(encoded(new)) > MAX_BYTES:
                break
            chosen, out = [*chosen, m], new
        if out is None:
            raise RetrievalError("budget_too_small", "the seed doesn't fit")
        return out

    def status(self) -> dict:
        return {"index_id": self.index.index_id, "items": int(self.index.facts["items_rows"]), "scopes": self.index.scope_counts(), "versions": {k: v for k, v in self.index.facts.items() if not k.endswith("_rows")}}
