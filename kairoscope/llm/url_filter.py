"""URL filter: rules by host and path first, else a logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table of urls (``LABELLED``, or the caller's,
at most ``MOST_LABELLED`` rows) and scores the urls of an Arrow batch together.

A null url, or one without ``://``, has an empty host and path; no rule fits it and the model
judges the empty text. Urls of any length are judged whole. Repeated rows and rows without an id keep
their rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.shingles import mix

MOST_LABELLED = 10_000
BITS = 14
GRAMS = (2, 3, 4, 5)
#: (action, host, path), as the contract of op7 states them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The labelled table: what people would block, and what they would keep. Fixed values, one url a word.
_BLOCKED = """
rx-discount-meds.biz/order/generic-tablets buypills247.ru/no-prescription pharmacy-online-sale.info/cheap/tablets.html
cialis-deals.top/buy-now?aff=12 diet-pill-offers.xyz/lose-weight-fast weightloss-miracle.club/free-trial
royal-slots-casino.bet/bonus/spins megajackpot-poker.win/deposit luckyspin777.casino/free-spins betting-odds-king.top/register
poker-bonus-codes.club/no-deposit roulette-winner.xyz/systems sexy-chat-live.cam/girls/online adultdating4u.club/hookup/tonight
xxx-clips-tube.porn/videos/hd hotwebcams.xxx/live nude-photo-share.info/gallery fast-loans-today.loan/apply/bad-credit
payday-cash-now.biz/instant-approval credit-repair-tricks.info/fix earn-money-at-home.click/make-500-a-day
forex-robot-profit.trade/signup crypto-doubler.top/invest/btc bitcoin-giveaway.live/claim binary-options-profit.online/register
free-gift-cards.win/survey/claim-prize iphone-winner.click/congratulations you-won-prize.gdn/claim.php survey-rewards.stream/win
replica-watches-shop.ru/rolex/cheap fake-designer-bags.store/sale knockoff-shoes.top/outlet/buy essay-writers-cheap.org/order
keygen-crack-serial.ws/download full-version-warez.to/cracked torrent-movies-free.pw/download nulled-scripts.download/premium
free-mp3-ringtones.mobi/download seo-backlinks-bulk.biz/buy/1000-links link-exchange-network.info/add-url article-spinner.click/autoblog
traffic-bots.top/buy-visitors buy-followers-likes.shop/instagram guestbook-spam.ru/viagra.html directory-submitter.info/links.php
hacked-accounts.su/dump/cards cc-dumps-shop.cc/fresh malware-cleaner-alert.online/scan/virus-found your-pc-infected.support/call-now
antivirus-free-scan.club/download.exe update-flash-player.pw/install.exe phish-bank-login.ga/secure/verify.php account-verify-alert.tk/login
paypal-confirm-limited.ml/signin enlargement-pills.biz/men/size escort-city-guide.club/vip miracle-cure-secrets.info/doctors-hate-this
""".split()
_KEPT = """
townlibrary.org/catalogue/search university-press.edu/journals/history physics.stateuniversity.edu/people/faculty
museum-of-art.org/exhibitions/2019 national-weather.gov/forecast/coast citycouncil.gov/minutes/2021-03 parliament.uk/bills/readings
dailyherald.com/news/local/school-opening eveningpost.co.uk/sport/football/report worldreport.com/politics/election-results
gardeners-almanac.com/spring/pruning-roses bakingathome.net/recipes/sourdough-bread familycooking.com/soups/lentil
hikingtrails.info/alps/hut-to-hut trainspotter.org.uk/timetables/1954 birdwatching-club.org/species/kingfisher
openstreetatlas.org/wiki/tagging linuxhandbook.io/filesystems/mount python-tutorials.dev/decorators/intro compilers.blog/parsing/grammars
developer-docs.io/api/reference/arrays mathforum.org/algebra/linear chemistry-lessons.org/acids-and-bases astronomyclub.net/observing/jupiter
encyclopedia.com/biographies/composers poetryarchive.org/poets/romantic literature-review.org/essays/novel theatre-company.co.uk/tickets/hamlet
symphonyhall.org/concerts/season music-lessons.com/violin/scales oldbooks.org/catalog/gutenberg genealogy-records.org/parish/1840
healthservice.nhs.uk/conditions/asthma hospital-trust.org/visiting-hours childrens-clinic.org/vaccination pharmacology.edu/lectures/week-3
farmersmarket.org/stalls/honey beekeeping.co.uk/hives/winter woodworkers-guild.org/joints/dovetail knitting-patterns.net/scarf
carpentry-school.com/courses/beginners sailing-club.org/regatta/results chess-federation.org/games/annotated cycling-routes.eu/rhine
stadtbibliothek.de/veranstaltungen zeitung-am-morgen.de/politik/wahl rathaus.at/buergerservice mairie.fr/demarches/passeport
journal-du-matin.fr/culture/cinema bibliotheque.fr/horaires universidad.es/facultad/derecho diario-regional.es/deportes/futbol
museo-nacional.es/coleccion ayuntamiento.es/tramites consumer-advice.org/rights/returns tax-office.gov/forms/guide
lawreview.edu/articles/contracts court-records.gov/opinions/2020 environment-agency.gov/rivers/levels geology-survey.org/maps/bedrock
""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of the labelled table."""
    cut = lambda url: (url.partition("/")[0], "/" + url.partition("/")[2])
    return [(*cut(u), 1) for u in _BLOCKED] + [(*cut(u), 0) for u in _KEPT]


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the url and the bucket, for each distinct n-gram of the hosts and, hashed apart, the paths; the last bucket is a constant."""
    keys = [np.arange(len(hosts), dtype=np.int64) << 32 | 1 << BITS]
    for mark, texts in ((1, hosts), (2, paths)):
        padded = [f"^{t}$".encode() for t in texts]
        data, sizes = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64), np.array([len(p) for p in padded], np.int64)
        url = np.repeat(np.arange(len(texts)), sizes)
        for n in GRAMS:
            m = len(data) - n + 1
            if m > 0:
                h = np.full(m, mark * 8 + n, np.uint64)
                for i in range(n):
                    h = mix(h ^ data[i : m + i])
                inside = url[:m] == url[n - 1 :]
                keys.append(np.unique(url[:m][inside] << 32 | (h[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64)))
    key = np.unique(np.concatenate(keys))
    return key >> 32, key & 0xFFFFFFFF


def fit(labelled: list[tuple[str, str, int]], steps: int = 200, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Weights by full-batch gradient steps; the loss of each label counts half."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"the labelled table may have {MOST_LABELLED} rows")
    at, columns = features([h for h, _, _ in labelled], [p for _, p, _ in labelled])
    scale = 1 / np.sqrt(np.bincount(at, minlength=len(labelled)))
    y = np.array([label for *_, label in labelled], dtype=float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, total = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(steps):
        z = np.bincount(at, w[columns], len(labelled)) * scale
        slope = share * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(columns, (slope * scale)[at], len(w)) + penalty * w / max(1, len(labelled))
        total += g * g
        w -= rate * g / np.sqrt(total + 1e-12)
    return w


def score(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability of each url that it is to be blocked."""
    at, columns = features(hosts, paths)
    sums, n = np.bincount(at, w[columns], len(hosts)), np.bincount(at, minlength=len(hosts))
    return 1 / (1 + np.exp(-sums / np.sqrt(n)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring_index(substring(__url, instr(__url, '://') + 3), '#', 1)"))
    rest = F.substring_index(rest, "?", 1)
    host = F.coalesce(F.substring_index(rest, "/", 1), F.lit(""))
    path = F.coalesce(F.substring(rest, F.length(host) + 1, F.length(rest)), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labelled: list[tuple[str, str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``id_col``, host, path, rule, verdict and block_score (the model's) for every row."""
    rules = RULES if rules is None else rules
    weights = fit(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # 128 KiB, whatever the input

    @F.pandas_udf("double")
    def block_score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(score(shared.value, p["host"].tolist(), p["path"].tolist()))

    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    host, path = split_url(F.col("__url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    # The longest rule that fits comes first.
    rule = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, action).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("block_score", block_score(F.struct("host", "path")))
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "block_score")
