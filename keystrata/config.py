"""Settings of a store."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Config:
    """Validated on creation. ``data_structure``, ``cache_size``, ``wal_segment_size`` and the thinning degrees are accepted for compatibility; Spark and Parquet decide those."""

    wal_segment_size: int = 1024
    table_size: int = 100
    data_structure: str = "hashmap"
    number_of_tables: int = 1
    index_thinning: int = 5
    summary_thinning: int = 5
    bloom_fpp: float = 0.0001
    compaction: str = "sizetiered"
    max_level: int = 4
    level_size: int = 2
    level_multiplier: int = 1
    cache_size: int = 10
    bucket_capacity: int = 3
    bucket_period: int = 10
    rate_limit: bool = False

    def __post_init__(self) -> None:
        at_least = {"wal_segment_size": 1, "table_size": 1, "number_of_tables": 1, "index_thinning": 1, "summary_thinning": 1, "max_level": 4, "level_size": 2, "level_multiplier": 1, "cache_size": 1, "bucket_capacity": 1}
        for name, least in at_least.items():
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if not 0 < self.bloom_fpp <= 1:
            raise ValueError("bloom_fpp must be over 0 and at most 1")
        if self.data_structure not in ("hashmap", "skiplist", "btree"):
            raise ValueError("data_structure must be hashmap, skiplist or btree")
        if self.compaction not in ("sizetiered", "leveled"):
            raise ValueError("compaction must be sizetiered or leveled")

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file; a missing file gets the defaults, an invalid one is not used."""
        try:
            with open(path) as f:
                given = json.load(f)
            known = {x.name for x in fields(cls)}
            return cls(**{k: v for k, v in given.items() if k in known})
        except FileNotFoundError:
            out = cls()
            with open(path, "w") as f:
                json.dump(asdict(out), f, indent=1)
            return out
        except (ValueError, TypeError, AttributeError):
            return cls()
