"""What is told about a page: codes with their severity, message and suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code: severity, message, suggestion. {page} is the site's label or address.
TEXTS = {
    "NO_BID_DATA": ("error", "No cash-bid table was found on {page}.", "Check that the address is that of the bids page itself."),
    "PARTIAL_COLUMNS": ("warn", "A table on {page} was read, but not which column holds the price.", "Compare the report with the page."),
    "LOW_CONFIDENCE_EXTRACTION": ("warn", "{page} may hold a bid table, but it is not certain that it was read right.", "Compare a row or two with the page."),
    "STALE_ASOF": ("warn", "{page} says that its bids are some days old.", "If this goes on, look for a newer page."),
    "STALE_REPEAT": ("warn", "{page} has shown the same numbers for several scans.", "Markets move daily; the page may be frozen."),
    "STALE_DELIVERY": ("warn", "All deliveries on {page} are in the past.", "Look for a current page on the site."),
    "DUPLICATE_PAGE_OVERLAP": ("warn", "{page} shows the same bids as another page of the company.", "One of the two can go."),
    "ROBOTS_BLOCKED": ("warn", "{page} asks automatic readers to stay away, so it was not read.", "Open it in a browser."),
    "TIMEOUT": ("error", "{page} took too long to answer.", "It is tried again at the next scan."),
    "NETWORK_FAIL": ("error", "{page} could not be reached.", "Check the address."),
    "HTTP_404": ("error", "{page} is gone.", "Look for a new page on the site."),
    "HTTP_403_BOTBLOCK": ("error", "{page} turns automatic readers away.", "Open it in a browser and try later."),
    "HTTP_5XX": ("warn", "The server of {page} has a fault.", "It is tried again at the next scan."),
    "HTTP_429": ("warn", "{page} asks for longer pauses.", "It is tried again at the next scan."),
    "PLAYWRIGHT_MISSING": ("error", "{page} needs a browser to be read, and there is none.", "Give the scan a renderer."),
    "RENDER_TIMEOUT": ("warn", "{page} did not finish loading in the browser.", "It is tried again at the next scan."),
    "RESOLVE_FAILED": ("error", "No website was found for {page}.", "Give its address instead."),
    "RESOLVE_AMBIGUOUS": ("warn", "Several websites may belong to {page}.", "Choose one, or give the address."),
    "BAD_URL": ("error", "{page} is not a web address.", "Give an address with a domain."),
    "DNS_FAIL": ("error", "The domain of {page} does not exist.", "Check the address."),
    "SCAN_INTERNAL_ERROR": ("error", "{page} could not be worked on.", "Report it."),
}


def described(flags: DataFrame, page: Column) -> DataFrame:
    """Adds severity, message and suggestion to rows with a code."""

    def told(k: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for code, texts in TEXTS.items() for x in (code, texts[k])]), F.col("code"))

    return flags.withColumns({"severity": told(0), "message": F.replace(told(1), F.lit("{page}"), page), "suggestion": told(2)})
