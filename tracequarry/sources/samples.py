"""Three made-up traces to try things with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .payloads import Chain


def samples() -> list[Chain]:
    """A figure and its hedge lost, a ban broken, and a chain that stays true to its source."""
    return [
        Chain("harvest", "Keep the range and the doubt.").source("source", "Field notes", "Early counts suggest the new seed may raise yields by 4 to 9 percent. This is not confirmed.").handoff("digest", "Digest", "Early counts suggest yields may rise by 4 to 9 percent; this is not confirmed.").handoff("headline", "Headline", "The new seed raises all yields by 9 percent."),
        Chain("refund", "Do not send money without human approval.").source("source", "Ticket", "The customer asks for $120 back. Do not pay before a lead agrees.").handoff("triage", "Triage", "A refund of $120 is asked for; a lead has not agreed.").handoff("payer", "Payer", "The refund of $120 was sent."),
        Chain("calm").source("source", "Memo", "The office opens at noon.").handoff("relay", "Relay", "The office opens at noon."),
    ]


def stages(spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.to_frame(spark) for c in samples()])
