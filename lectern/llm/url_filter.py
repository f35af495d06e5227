"""URL filters: path rules first, then logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits the host and all its subdomains, and
of the rules that fit the longest wins, of equal ones the first in the list.  Urls without a rule get the verdict of a
logistic regression over the hashed character n-grams of host and path, trained from a
small labelled table of urls.

Scale: rules and weights have sizes of their own (rules at most :data:`MAX_RULES`) and go
along with the task; only the url column is read; nothing is shuffled.

Cases: a null url and one without ``://`` have an empty host and path, fit no rule and get
the regression's verdict for no n-grams at all, its bias; repeated rows are judged each for itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

MAX_RULES = 1_000_000

# The production rules, verdict and host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# The labelled table's hosts, written down by hand, and the paths that its urls take in turn.
BLOCK_HOSTS = """
casino-win.com free-bets.net cheap-pills.biz online-casino.info pokerslots.club payday-loans-now.com viagra-shop.biz replica-watches.ru
jackpotcity.win adult-cams.tv crypto-doubler.io miracle-cure.shop free-prizes.click keygen-crack.to xxx-video.tv fast-cash-loans.com
pills-online.top bets-bonus.win ads-tracker.net pixel-track.net ads-server.com spam-links.net link-farm.org spamblog.info adult-chat.com
xrated-videos.com slots-bonus.com bestcasino.club win-prizes.top cheap-replica.shop cracked-software.to serial-keygen.net torrent-cracks.ru
hot-singles-dating.click forex-millions.biz bitcoin-casino.io weight-loss-pills.com diet-miracle.top penny-loans.biz betting-tips-win.com
poker-bonus.net casino-spins.com freespins.win lottery-winner.click click-tracker.com adserver-cdn.net banner-ads.biz popup-ads.net
seo-backlinks.info buy-backlinks.net linkexchange-farm.com porn-tube.tv sexcams.club escort-girls.info steroid-shop.biz fake-diploma.com
cheap-meds.top no-prescription-pharmacy.biz instant-cash-advance.com crypto-giveaway.io double-your-coins.net spyware-cleaner-free.top
""".split()
ALLOW_HOSTS = """
citylibrary.org national-museum.org dailynews.com weather-service.gov stateuniversity.edu openwiki.org devdocs.io homerecipes.com
gardening-notes.com local-history.org sciencejournal.org travel-guide.com street-maps.com folkmusic.org primary-school.edu city-council.gov
independent-bookshop.com amateur-astronomy.org football-league.com cycling-club.org hiking-trails.org birdwatching.net photography-blog.com
opensource-projects.io programming-tutorials.com math-lessons.edu chemistry-lab.edu physics-forum.org medical-journal.org hospital-trust.org
public-health.gov tax-office.gov parliament.gov railway-timetable.com airport-info.com bus-routes.net film-reviews.com theatre-season.org
art-gallery.org architecture-review.com poetry-archive.org short-stories.net translation-society.org language-school.com chess-club.org
knitting-patterns.com woodworking-shop.com bakery-recipes.com vegetable-garden.net farmers-market.org animal-shelter.org river-trust.org
climate-data.org ocean-research.org geology-survey.gov forestry-commission.gov village-hall.org parish-church.org community-theatre.net
running-club.org swimming-pool.com tennis-association.org family-tree.net genealogy-records.org photo-archive.org radio-station.com
tv-schedule.com newspaper-archive.com economics-review.org law-society.org job-centre.gov housing-association.org charity-trust.org
school-meals.edu student-union.edu alumni-network.edu conference-papers.org patent-search.gov standards-body.org statistics-bureau.gov
energy-saving.org solar-power-guide.com electric-bikes.net car-maintenance.com motor-museum.org model-railways.net stamp-collectors.org
coin-museum.org antique-clocks.net pottery-studio.com piano-lessons.com choir-concerts.org orchestra-hall.org dance-academy.com
""".split()
ENDINGS = "com net org edu gov info co.uk de fr es".split()
PREFIXES = ("", "www.", "m.", "blog.")
ALLOW_PATHS = ("/", "", "/about", "/en/news/1042", "/articles/reading-list.html", "/fr/77.html", "/de/archiv/5310/", "/wiki/Main_Page", "/2021/03/report", "/es/208", "/events/spring")
BLOCK_PATHS = ("/", "", "/bonus", "/en/win/1042", "/buy-now.html", "/fr/77.html", "/de/gratis/5310/", "/free?ref=9", "/signup/vip", "/es/208", "/deal/today")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): each host as written and with other endings, prefixes and paths in turn.

    Either class has hosts of every ending, so that it tells nothing.
    """
    rows = []
    for label, hosts, paths in ((1, BLOCK_HOSTS, BLOCK_PATHS), (0, ALLOW_HOSTS, ALLOW_PATHS)):
        for k, host in enumerate(hosts):
            name, _, ending = host.partition(".")
            for step in range(4):
                other = ENDINGS[(3 * k + 7 * step) % len(ENDINGS)] if step else ending
                rows.append((f"https://{PREFIXES[(k + step) % len(PREFIXES)]}{name}.{other}{paths[(5 * k + 3 * step) % len(paths)]}", label))
    return rows


_URL = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host = _URL.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


class Rules:
    """The longest fitting rule of a url."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"at most {MAX_RULES} rules")
        self._by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            self._by_host.setdefault(host, []).append((slash + rest, rule, verdict))

    def __call__(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while host and at >= 0:
            for start, rule, verdict in self._by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1 or -1
        return best


class Regression:
    """Logistic regression on hashed n-grams (lengths 3 to 5) of host and path."""

    BITS, LENGTHS = 16, (3, 4, 5)

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(1 << self.BITS), 0.0

    @classmethod
    def features(cls, host: str, path: str) -> np.ndarray:
        """Bucket numbers, each once; digits count alike."""
        grams = {(k, text[i : i + n]) for k, text in enumerate((f"^{host}$", f"^{re.sub(r'[0-9]+', '0', path)}$")) for n in cls.LENGTHS for i in range(max(0, len(text) - n + 1))}
        return np.unique(np.array([xxhash.xxh64_intdigest(g.encode(), k) & (1 << cls.BITS) - 1 for k, g in grams], np.int64))

    def fit(self, rows: Sequence[tuple[str, int]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Regression:
        examples = [(self.features(*host_and_path(url)), label) for url, label in rows]
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(examples)):
                at, label = examples[k]
                scale = max(len(at), 1) ** -0.5
                slope = (self._probability(at) - label) * rate
                self.weights[at] -= slope * scale + rate * decay * self.weights[at]
                self.bias -= slope * 0.1
        return self

    def _probability(self, at: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights[at].sum() * max(len(at), 1) ** -0.5 + self.bias, -30, 30)))

    def probability(self, host: str, path: str) -> float:
        """That the url is to be blocked."""
        return float(self._probability(self.features(host, path)))


@lru_cache(maxsize=1)
def production_regression() -> Regression:
    return Regression().fit(labelled_urls())


def regression_of(labelled: DataFrame, max_rows: int = 20_000) -> Regression:
    """Trained on a small table of (url, label), 1 for block; a larger one is an error, as it is read by the driver."""
    rows = [(r["url"], int(r["label"])) for r in labelled.select("url", "label").where("label is not null").limit(max_rows + 1).collect()]
    if len(rows) > max_rows or len({label for _, label in rows}) < 2:
        raise ValueError(f"the labelled table has at most {max_rows} rows and both labels")
    return Regression().fit(sorted(rows, key=str))


SCHEMA = "page_id bigint, host string, path string, rule string, verdict string, block_probability double"


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, regression: Regression | None = None, threshold: float = 0.5) -> DataFrame:
    """See :data:`SCHEMA`; ``block_probability`` is the regression's, whatever the rules say."""
    model = regression or production_regression()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Rules(rules)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                found, p = longest(host, path), model.probability(host, path)
                rows.append((host, path, *(found or (None, "block" if p >= threshold else "allow")), p))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    return pages.select("page_id", "url").mapInArrow(work, SCHEMA)
