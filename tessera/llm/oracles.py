"""DuckDB SQL of the operators on embeddings, a row for each component."""

from __future__ import annotations

FINITE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64"


def clusters(k: int = 40, rounds: int = 5, salt: int = 2) -> str:
    steps = [
        f"kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, embedding from embeddings where {FINITE})",
        "x as materialized (select r, i, cast(floor(256 * cast(embedding[i] as double)) as bigint) as x from kept, range(1, 65) t(i))",
        f"s as (select r, row_number() over (order by sha256('{salt}:' || vec_id), r) - 1 as c from kept qualify c < {k})",
        "c0 as materialized (select c, i, x from s join x using (r))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) as d from x join c{n} c using (i) group by 1, 2)")
        steps.append(f"a{n} as materialized (select r, c, d from d{n} qualify row_number() over (partition by r order by d, c) = 1)")
        if n < rounds:
            steps.append(f"m{n} as (select c, i, cast(floor(sum(x) / count(*)) as bigint) as x from a{n} join x using (r) group by 1, 2)")
            steps.append(f"c{n + 1} as materialized (select c, i, coalesce(m.x, o.x) as x from c{n} o left join m{n} m using (c, i))")
    steps.append(f"h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from c{rounds} group by c)")
    steps.append(f"t as (select c, sum(d) as t from a{rounds} group by c)")
    return f"with {', '.join(steps)} select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(t as bigint) as cluster_inertia, cast((select sum(d) from a{rounds}) as bigint) as inertia, h as centroid_sha256 from a{rounds} join kept using (r) join t using (c) join h using (c)"


def codes(positions: int = 16, entries: int = 64, rounds: int = 2) -> str:
    width = 64 // positions
    steps = [
        f"kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding from embeddings where {FINITE})",
        f"x as materialized (select r, (i - 1) // {width} as p, (i - 1) % {width} as j, cast(floor(256 * cast(embedding[i] as double)) as bigint) as x from kept, range(1, 65) t(i))",
        f"b0 as materialized (select p, r - 1 as e, j, x from x where r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select x.r, p, b.e, sum((x.x - b.x) * (x.x - b.x)) as d from x join b{n} b using (p, j) group by 1, 2, 3)")
        steps.append(f"a{n} as materialized (select r, p, e, d from d{n} qualify row_number() over (partition by r, p order by d, e) = 1)")
        if n < rounds:
            steps.append(f"m{n} as (select p, e, j, cast(floor(sum(x) / count(*)) as bigint) as x from a{n} join x using (r, p) group by 1, 2, 3)")
            steps.append(f"b{n + 1} as materialized (select p, e, j, coalesce(m.x, o.x) as x from b{n} o left join m{n} m using (p, e, j))")
    steps.append(f"c as (select r, string_agg(lower(printf('%02x', e)), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by r)")
    steps.append(f"h as (select sha256(string_agg(cast(x as varchar), ',' order by p, e, j)) as h from b{rounds})")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from c join kept using (r), h"
