"""Session settings the plans are designed for. A user passes them to the session builder; the library sets nothing."""

from __future__ import annotations

_MB = 1 << 20


def scale_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Spark SQL settings for an input of ``input_bytes`` read by ``cores`` task slots; the same rules at every size.

    Shuffled rows are a fraction of the raw text, so 2 GB of input per shuffle partition leaves a few hundred MB
    of shuffled data each; adaptive execution merges small partitions and splits skewed ones from there. Files and merged
    partitions are cut so that every slot gets about four, within what one task handles well.
    """
    per_task = input_bytes // (4 * cores)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Partitions follow the advisory size; that size already spreads a small input over all slots.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(max(per_task, _MB // 4), 256 * _MB)),
        "spark.sql.shuffle.partitions": str(max(-(-input_bytes // (2048 * _MB)), cores)),
        "spark.sql.files.maxPartitionBytes": str(min(max(per_task, 4 * _MB), 512 * _MB)),
        # Partitioned writes have at most nine claim files of a few years: their files stay open side by side.
        "spark.sql.maxConcurrentOutputFileWriters": "100",
        # The JVM never compiles methods above this size; Spark then runs wide rows as several smaller ones instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Recording the source line of every column expression makes building large plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
    }
