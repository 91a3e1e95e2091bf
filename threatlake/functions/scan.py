"""Running totals and last-known values that do not put one key into one task.

A plain ``OVER (PARTITION BY key ORDER BY ts)`` sends every row of a key to a single task. When
one host or process produces a third of all events, that task never ends. Sums and "last non-null"
are associative, so they are computed as a two-level prefix scan instead. The time line, not the keys, is cut into as many
segments as there are shuffle partitions, at places drawn from a sample of (time, sequence number): each holds about the same number of rows,
also where most of them fall into one hour or one instant.

1. inside ``(key, segment)`` with an ordinary window, which no key can overload;
2. over one summary row per ``(key, segment)``;
3. the carry of the earlier segments is joined back by equality on ``(key, segment)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Bounds = list[tuple[int, int]]
#: Sampled rows per segment.
PER_SEGMENT = 64
_BUCKET = "__bucket"


def order_bounds(df: DataFrame, order: list[str]) -> Bounds:
    """Where the segments of ``order`` (a time and a number) begin. One narrow pass that returns PER_SEGMENT rows for each of them; the sample is taken by
    hash, so the same rows give the same segments."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.unix_micros(F.col(order[0]).cast("timestamp")).alias("t"), F.coalesce(F.col(order[1]).cast("long"), F.lit(-1)).alias("s"))
    sample = sorted(tuple(r) for r in rows.where("t IS NOT NULL").orderBy(F.xxhash64("s", "t")).limit(parts * PER_SEGMENT).collect())
    return sorted(set(sample[PER_SEGMENT::PER_SEGMENT]))


def segment_of(order: list[str], bounds: Bounds) -> Column:
    """Number of bounds at or before a row, by halving."""
    if not bounds:
        return F.lit(0)
    times, numbers = (F.lit([b[i] for b in bounds]) for i in (0, 1))
    place = F.struct(
        F.unix_micros(F.col(order[0]).cast("timestamp")).alias("t"), F.coalesce(F.col(order[1]).cast("long"), F.lit(-1)).alias("s"),
        times.alias("times"), numbers.alias("numbers"),
    )

    def search(p: Column) -> Column:
        def further(low: Column, step: Column) -> Column:
            t, s = F.get(p.getField("times"), low + step - 1), F.get(p.getField("numbers"), low + step - 1)
            return low + F.when((t < p.getField("t")) | ((t == p.getField("t")) & (s <= p.getField("s"))), step).otherwise(0)

        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)

    return F.element_at(F.transform(F.array(place), search), 1)


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    bounds: Bounds | None = None,
    inclusive: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running ``sums`` and last-known ``lasts`` per ``keys`` in ``order``, a time and a number.

    ``bounds`` are those of ``order_bounds``, drawn from the rows themselves if not given; scans over the same events can share them.
    ``inclusive`` decides whether a row sees its own value. Null keys form one group of their own. The rows are read twice, so scans of scans
    would double their work each time: ``source`` holds the same rows where they are cheaper to read, such as those below an earlier scan.
    """
    bounds = order_bounds(df, order) if bounds is None else bounds
    sums, lasts = sums or {}, lasts or {}
    value = {n: f"__v_{n}" for n in [*sums, *lasts]}

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({_BUCKET: segment_of(order, bounds)})
        return rows.withColumns({value[n]: c for n, c in {**sums, **lasts}.items()})

    source = placed(df if source is None else source)
    df = placed(df)
    end = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    scanned = df.withColumns(
        {
            **{f"__l_{n}": F.sum(value[n]).over(local) for n in sums},
            **{f"__l_{n}": F.last(value[n], ignorenulls=True).over(local) for n in lasts},
        }
    )
    place = F.struct(*order)
    summary = source.groupBy(*keys, _BUCKET).agg(
        *[F.sum(value[n]).alias(f"__s_{n}") for n in sums],
        *[
            F.max_by(F.col(value[n]), F.when(F.col(value[n]).isNotNull(), place)).alias(f"__s_{n}")
            for n in lasts
        ],
    )
    across = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        F.col(_BUCKET).alias("__b"),
        *[F.sum(f"__s_{n}").over(across).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__s_{n}", ignorenulls=True).over(across).alias(f"__c_{n}") for n in lasts],
    ).where(
        " OR ".join(f"`__c_{n}` IS NOT NULL" for n in [*sums, *lasts])
    )
    on = F.col(_BUCKET) == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    joined = scanned.join(carry, on, "left")
    zero = {n: F.coalesce(F.col(f"__c_{n}"), F.lit(0)) + F.coalesce(F.col(f"__l_{n}"), F.lit(0)) for n in sums}
    last = {n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in lasts}
    helpers = [_BUCKET, "__b", *value.values()]
    helpers += [f"__k_{i}" for i in range(len(keys))]
    helpers += [f"__{p}_{n}" for n in [*sums, *lasts] for p in ("l", "c")]
    return joined.withColumns({**zero, **last}).drop(*helpers)
