"""Voice quality estimate from loss and jitter, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec impairment at zero loss and robustness to loss (G.113 appendix figures).
CODEC_IMPAIRMENT = {
    "PCMU": (0.0, 4.3), "PCMA": (0.0, 4.3), "L16": (0.0, 4.3), "G711": (0.0, 4.3),
    "G722": (13.0, 20.0), "G726": (7.0, 23.0), "G72632": (7.0, 23.0), "G728": (7.0, 19.0),
    "G729": (11.0, 19.0), "G729A": (11.0, 19.0), "G729AB": (11.0, 19.0), "G729B": (11.0, 19.0),
    "G723": (15.0, 16.1), "G7231": (15.0, 16.1), "GSM": (20.0, 10.0), "GSMEFR": (5.0, 10.0),
    "ILBC": (11.0, 10.0), "AMR": (8.0, 10.0), "AMRWB": (7.0, 10.0), "EVS": (5.0, 10.0),
    "OPUS": (5.0, 10.0), "SPEEX": (15.0, 10.0),
}


def round_half_up(x: Column, places: int) -> Column:
    """floor(x*10^n + 0.5): halves go up also below zero, unlike ``round``."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def estimate_mos(loss_pct: Column, jitter_ms: Column, codec: Column) -> Column:
    """Simplified E-model (ITU-T G.107), 1.0 to 4.5 with two decimals. An estimate, never a measurement."""
    key = F.regexp_replace(F.upper(F.coalesce(codec, F.lit(""))), r"[^A-Z0-9]", "")
    table = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("ie"), F.lit(x[1]).alias("bpl"))
        for kv in CODEC_IMPAIRMENT.items() for x in kv
    ])
    hit = F.try_element_at(table, key)
    ie = F.coalesce(hit["ie"], F.lit(0.0))
    bpl = F.coalesce(hit["bpl"], F.lit(10.0))
    loss = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(loss_pct, F.lit(0.0)).cast("double")))
    delay = 30.0 + 2.0 * F.greatest(F.lit(0.0), F.coalesce(jitter_ms, F.lit(0.0)).cast("double"))
    late = F.when(delay > 177.3, 0.11 * (delay - 177.3)).otherwise(0.0)
    r = 93.2 - (0.024 * delay + late) - (ie + (95.0 - ie) * (loss / (loss + bpl)))
    mos = (
        F.when(r < 0, F.lit(1.0))
        .when(r > 100, F.lit(4.5))
        .otherwise(1.0 + 0.035 * r + r * (r - 60.0) * (100.0 - r) * 7e-6)
    )
    return round_half_up(F.greatest(F.lit(1.0), F.least(F.lit(4.5), mos)), 2)
