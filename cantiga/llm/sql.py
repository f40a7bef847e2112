"""SQL for the queries that SQL can express."""

from __future__ import annotations

from cantiga.llm.url_templates import Rule, TreeSettings


def shards_sql(limit: int) -> str:
    return f"""
    WITH rows AS (
        SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits FROM documents
    ), nodes AS (
        SELECT depth, bits >> (60 - depth) AS prefix, sum(bytes) AS bytes, count(*) AS n FROM rows, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY depth, prefix
    ), placed AS (
        SELECT r.doc_id, r.bytes, r.bits, min(n.depth) AS depth
        FROM rows r JOIN nodes n ON n.prefix = r.bits >> (60 - n.depth) WHERE n.bytes <= {limit} OR n.n = 1 GROUP BY r.doc_id, r.bytes, r.bits
    )
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits >> (60 - depth)), depth, '0') END AS shard, depth, bytes FROM placed
    """


def _fits(rule: Rule) -> str:
    return f"(host = '{rule.host}' OR host LIKE '%.{rule.host}') AND starts_with(path, '{rule.path}')"


def urls_sql(rules: list[Rule], s: TreeSettings) -> str:
    """The tree level by level, as one recursion over all paths."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule = " ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in ordered)
    weight = f"{s.weight}::DOUBLE"
    return f"""
    WITH RECURSIVE after AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages
    ), parted AS (
        SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM after
    ), known AS (
        SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1
    ), urls AS (
        SELECT page_id, host, path, good FROM parted LEFT JOIN known ON doc_id = page_id
    ), walk AS (
        SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, count(*) AS n, coalesce(sum(good), 0)::BIGINT AS good, count(good) AS labelled,
            '' AS node, 0 AS last, 0 AS level
        FROM urls GROUP BY host, path
        UNION ALL
        SELECT host, path, parts, n, good, labelled, node || '/' || CASE WHEN apart THEN segment ELSE '*' END, CASE WHEN apart THEN level + 1 ELSE last END, level + 1
        FROM (
            SELECT *, all_n > {s.least_rows} AND all_g > 0 AND all_l > all_g AS is_open,
                segment NOT IN ('*', '**') AND of_n >= {s.least_rows} AND l > 0 AND all_l > l
                AND abs(g / l - (all_g - g) / (all_l - l)) >= {s.z}::DOUBLE * sqrt(pooled * (1.0::DOUBLE - pooled) * (1.0::DOUBLE / l + 1.0::DOUBLE / (all_l - l))) AS apart
            FROM (
                SELECT *, (all_g + 1.0::DOUBLE) / (all_l + 2.0::DOUBLE) AS pooled FROM (
                    SELECT *, sum(n) OVER at_node AS all_n, (sum(good) OVER at_node)::DOUBLE AS all_g, (sum(labelled) OVER at_node)::DOUBLE AS all_l,
                        sum(n) OVER at_branch AS of_n, (sum(good) OVER at_branch)::DOUBLE AS g, (sum(labelled) OVER at_branch)::DOUBLE AS l
                    FROM (SELECT *, parts[level + 1] AS segment FROM walk WHERE len(parts) > level)
                    WINDOW at_node AS (PARTITION BY host, node), at_branch AS (PARTITION BY host, node, segment)
                )
            )
        ) WHERE is_open
    ), settled AS (
        SELECT *, list_filter(string_split(node, '/'), lambda x: x <> '') AS tokens, greatest(last, least(len(parts), {s.levels})) AS shown
        FROM walk QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY level DESC) = 1
    ), named AS (
        SELECT host, path, good, labelled, '/' || array_to_string(list_concat(
            list_concat(tokens, list_transform(range(len(parts) - len(tokens)), lambda i: '*'))[:shown], CASE WHEN len(parts) > shown THEN ['**'] ELSE [] END), '/') AS template
        FROM settled
    ), of_template AS (
        SELECT host, template, sum(good)::DOUBLE AS good, sum(labelled)::DOUBLE AS labelled FROM named GROUP BY host, template
    ), prior AS (
        SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS prior FROM of_template
    ), hosts AS (
        SELECT host, (sum(good) + {weight} * any_value(prior)) / (sum(labelled) + {weight}) AS host_rate FROM of_template, prior GROUP BY host
    ), pure AS (
        SELECT host, template, (good + {weight} * host_rate) / (labelled + {weight}) AS purity FROM of_template JOIN hosts USING (host)
    )
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN purity < {s.purity}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict, template, purity
    FROM urls JOIN named USING (host, path) JOIN pure USING (host, template)
    """
