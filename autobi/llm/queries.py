"""The registered queries of this subpackage."""

from __future__ import annotations

from autobi.llm.decontaminate import op10_decontamination
from autobi.llm.merkle import op13_merkle
from autobi.llm.neighbours import op12_neighbours
from autobi.llm.prefix_trie import op11_prefix_trie
from autobi.llm.quality_bayes import op5_quality_classifier
from autobi.llm.quality_gbt import op7_quality_rules
from autobi.llm.sentencepiece_codec import op4_sentencepiece
from autobi.llm.simhash import op1_simhash
from autobi.llm.site_tree import op9_site_tree
from autobi.llm.suffix_dedup import op8_suffix_dedup
from autobi.llm.token_counts import op2_token_counts
from autobi.llm.token_files import op6_token_files
from autobi.llm.url_filter import LIMIT, RULES, op3_url_filter, terms

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_site_tree": op9_site_tree,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_neighbours": op12_neighbours,
    "op13_merkle": op13_merkle,
}


def _url_filter_sql() -> str:
    def fits(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"

    def found(weights) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT * {w}" for t, w in weights)

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    weights = terms()
    strict, soft = ([(t, 1) for t, w in weights.items() if (w >= LIMIT) is hard] for hard in (True, False))
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    by_rule = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    return f"""
    WITH cut AS (
      SELECT page_id, {lower("coalesce(url, '')")} AS low,
             CASE WHEN url LIKE '%://%' THEN {lower("regexp_extract(url, '(?s)^(.*?)://([^/?#]*)', 2)")} ELSE '' END AS host,
             CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^(.*?)://[^/?#]*([^?#]*)', 2) ELSE '' END AS path
      FROM pages),
    hit AS (SELECT *, {found(strict)} AS n_strict, {found(soft)} AS n_soft, {found(weights.items())} AS weight, {rule} AS rule FROM cut)
    SELECT page_id, host, path, rule,
           coalesce({by_rule}, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
    FROM hit"""


#: The others cannot be expressed in SQL over whole tables; they are tested against brute force in tests/llm.
ORACLES = {"op3_url_filter": _url_filter_sql()}
