"""URL filters (operator 8): rules, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table, which is a parameter (fixed values below by default): its size,
not the pages', bounds the training.  Rules fit a host and its subdomains and a beginning of the path; the longest wins.

* null urls and urls without ``://`` have an empty host and path: no rule, and the model judges two empty strings.
* ties between rules of one length go to the first by code point; null ids are kept; repeated rows get the same verdict;
  an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The labelled table, one host and path a word, written by hand from general knowledge and not from any table at hand.
#: Allowed: well-known public sites (reference, press, science, government, universities, museums, software, shops, forums, travel),
#: each with a path of its own kind.  Blocked: made-up addresses as gambling, adult, drug, advert, malware, fraud, loan, fake-goods
#: and piracy sites name themselves, with paths of their kind; their endings stand in shares like the other half's com, org and net.
BLOCKED = """
royalspin-casino.com/bonus/welcome luckyroulette88.org/register vegas-jackpot-online.com/play livecasinodealer.com/blackjack casino-nodeposit-bonus.net/claim
bet777sport.com/odds/today onlinebetting-tips.org/football-predictions bookmaker-bonus-codes.com/signup goldenslots-spins.org/free-spins megaslotmachine.com/jackpot
pokerchips-deposit.com/tournament videopoker-realmoney.org/join baccarat-vip.com/lobby keno-lottery-results.com/winners scratchcards-cash.net/instant
1xsportbet-mirror.com/login bingo-cash-prize.org/rooms dailyfantasy-wager.com/lineups roulette-strategy-win.org/system sportsbook-freebet.com/promo
hotgirls-webcam.com/live xxxtube-hd.org/videos/new milfdating-local.com/members freeporntube-mobile.com/watch nudecelebs-leaked.net/gallery
sexchat-anonymous.com/rooms eroticmassage-escorts.org/london-girls adultfriend-hookup.com/join-free camgirls-private.org/show hentai-xxx-stream.com/episode
escortdirectory-vip.com/city swingers-dating-club.org/profiles fetishvideos-pay.com/trailers livesex-cams24.com/models adultgames-3d.net/play
buy-viagra-noprescription.com/order cialis-generic-cheap.org/cart onlinepharmacy-rx24.com/pills tramadol-overnight.org/buy cheapmeds-canada-pharmacy.com/shop
weightloss-pills-miracle.com/before-after steroids-legal-buy.org/anabolic xanax-without-rx.com/order kamagra-jelly-discount.com/product testosterone-booster-trial.net/offer
ketodiet-pills-shark.com/special hairgrowth-miracle-serum.org/buy-now cbd-gummies-freetrial.com/claim phentermine-online-rx.org/checkout erection-pills-express.com/order
ads.clickserve-network.com/banner/728x90 adserver.popunder-media.org/delivery/afr track.affiliate-clicks.com/redirect?id pixel.datatracker-ads.com/collect cdn.adbanners-exchange.net/show
pop.trafficmonetizer.com/serve sync.retargeting-pixel.org/match click.cpa-offers-track.com/aff_c adclick.sponsored-links.org/go beacon.usertracking-stats.com/hit
native-ads-widget.com/loader.js doubleclicks-ad.org/imp push-notification-ads.com/subscribe offerwall-rewards.com/track banner-rotator-ads.net/rotate
free-iphone-winner.com/survey you-are-selected-prize.org/claim-reward giftcard-generator-free.com/amazon congratulations-winner.org/spin-wheel getfreevbucks-now.com/verify
robux-generator-nohuman.com/hack instagram-followers-free.org/boost unlimited-coins-cheats.com/generator survey-rewards-cash.com/start win-samsung-galaxy.net/entry
secure-paypal-verify.com/account/login appleid-locked-support.org/unlock bankofamerica-alert.com/signin/confirm netflix-billing-update.org/payment amazon-security-check.com/verify
microsoft-virus-warning.com/call-now wallet-recovery-phrase.org/restore dhl-parcel-fee.com/tracking/pay irs-tax-refund-claim.com/form facebook-login-secure.net/checkpoint
flashplayer-update-now.com/download pc-cleaner-speedup.org/setup.exe driver-updater-free.com/install codec-pack-required.org/get antivirus-alert-scan.com/scan
payday-loan-instant.com/apply badcredit-loans-approved.org/form fast-cash-advance.com/apply-now nocreditcheck-personal-loans.com/rates debt-relief-settlement.net/quote
bitcoin-doubler-invest.com/deposit forex-robot-profit.org/signals crypto-mining-earn.com/plans binary-options-millionaire.org/system earn-money-home-daily.com/join
passive-income-secret.com/webinar getrich-quick-method.org/video hyip-invest-daily.com/roi make-5000-weekly.com/start pumpdump-crypto-signals.net/telegram
replica-rolex-watches.com/submariner fake-designer-handbags.org/louis-vuitton cheap-jordans-outlet.com/shoes rayban-sunglasses-discount.org/sale louboutin-replica-shop.com/red-bottom
cheap-nfl-jerseys-china.com/wholesale oakley-outlet-store.org/80off michaelkors-bags-cheap.com/clearance uggboots-sale-online.com/women fakeid-documents-buy.net/passport
warez-full-download.com/crack keygen-serials-free.org/photoshop cracked-apk-mods.com/premium torrentmovies-free-hd.org/watch-online nulled-themes-plugins.com/download
freemovies-stream123.com/watch iptv-cheap-subscription.org/buy activator-windows-kms.com/download mp3-free-ripper.com/songs ebooks-pirate-pdf.net/free
buy-backlinks-cheap.com/packages seo-blast-links.org/order guestpost-links-market.com/buy pbn-links-service.org/pricing article-spinner-bulk.com/tool
bulkemail-leads-list.com/buy email-blaster-pro.org/unlimited essay-writing-cheap.com/order buy-diploma-degree.com/university write-my-paper-fast.net/order-now
mail-order-brides-russia.com/profiles asian-singles-dating.org/join psychic-reading-free.com/chat love-spell-caster.org/return-ex penis-enlargement-tips.com/method
"""
ALLOWED = """
en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Berlin fr.wikipedia.org/wiki/Paris es.wiktionary.org/wiki/palabra commons.wikimedia.org/wiki/Category:Maps
britannica.com/science/gravity-physics plato.stanford.edu/entries/kant merriam-webster.com/dictionary/serendipity dictionary.cambridge.org/grammar gutenberg.org/ebooks/1342
archive.org/details/texts openlibrary.org/works worldcat.org/search loc.gov/collections/maps bl.uk/manuscripts
bbc.co.uk/news/science-environment theguardian.com/books/reviews nytimes.com/section/world lemonde.fr/international elpais.com/cultura
spiegel.de/wissenschaft zeit.de/politik reuters.com/markets apnews.com/hub/us-news npr.org/sections/music
washingtonpost.com/opinions economist.com/leaders theatlantic.com/ideas newyorker.com/magazine corriere.it/esteri
aljazeera.com/economy cbc.ca/news/canada abc.net.au/radionational irishtimes.com/sport swissinfo.ch/eng
nature.com/articles science.org/journal arxiv.org/abs/1706.03762 jstor.org/stable/2346178 journals.plos.org/plosone
pubmed.ncbi.nlm.nih.gov/about who.int/news-room/fact-sheets cdc.gov/flu/prevention nhs.uk/conditions/asthma medlineplus.gov/diabetes
mayoclinic.org/diseases-conditions drugs.com/ibuprofen.html healthline.com/nutrition webmd.com/allergies cancer.org/research
nasa.gov/missions noaa.gov/climate usgs.gov/volcanoes nps.gov/yellowstone esa.int/Science_Exploration
europa.eu/youreurope un.org/sustainabledevelopment gov.uk/vehicle-tax bundestag.de/dokumente service-public.fr/particuliers
irs.gov/refunds usa.gov/benefits canada.ca/immigration senat.fr/rapports admin.ch/documentation
stanford.edu/research mit.edu/education ox.ac.uk/admissions ethz.ch/en/studies uni-heidelberg.de/institute
berkeley.edu/academics cam.ac.uk/colleges ocw.mit.edu/courses/mathematics coursera.org/learn/algorithms khanacademy.org/math/calculus
metmuseum.org/art/collection louvre.fr/oeuvres tate.org.uk/art/artists rijksmuseum.nl/collectie britishmuseum.org/exhibitions
moma.org/calendar museodelprado.es/coleccion si.edu/visit poetryfoundation.org/poems goodreads.com/book/show
docs.python.org/3/library/os.html postgresql.org/docs/current spark.apache.org/docs/latest numpy.org/doc/stable pandas.pydata.org/docs
github.com/apache/spark gitlab.com/gnome/gtk stackoverflow.com/questions/tagged/sql developer.mozilla.org/docs/Web kernel.org/doc/html
doc.rust-lang.org/book go.dev/blog r-project.org/about.html gnu.org/software/bash debian.org/releases
php.net/manual sourceforge.net/projects eclipse.org/downloads mozilla.org/firefox/new code.visualstudio.com/download
superuser.com/questions serverfault.com/tags mathoverflow.net/questions news.ycombinator.com/item reddit.com/r/askscience
youtube.com/watch vimeo.com/channels/staffpicks soundcloud.com/discover imdb.com/title rottentomatoes.com/top
allrecipes.com/recipe/soup seriouseats.com/bread bonappetit.com/recipes kingarthurbaking.com/learn rhs.org.uk/plants
amazon.com/gp/help ebay.com/b/cameras etsy.com/market/ceramics ikea.com/catalog zalando.de/schuhe
lonelyplanet.com/france/paris nationalrail.co.uk/stations sbb.ch/timetable bahn.de/angebot amtrak.com/routes
booking.com/city tripadvisor.com/museums airbnb.com/help openstreetmap.org/way weather.gov/forecast
fifa.com/worldcup olympics.com/athletes espn.com/nba/standings chess.com/lessons nba.com/schedule
paypal.com/help visa.com/security ecb.europa.eu/stats federalreserve.gov/monetarypolicy worldbank.org/data
oxfam.org/stories redcross.org/volunteer amnesty.org/reports wwf.org/species unicef.org/education
duolingo.com/course/fr edx.org/learn/history ted.com/talks researchgate.net/publication slideshare.net/category
speedtest.net/about battle.net/support behance.net/gallery daringfireball.net/linked asp.net/learn
blog.python.org/releases blog.mozilla.org/community blog.openstreetmap.org/news blog.oup.com/history blog.nationalarchives.gov.uk/records
m.dw.com/de/themen en.m.wikipedia.org/wiki/Tree history.com/topics smithsonianmag.com/arts-culture nationalgeographic.com/animals
microsoft.com/windows support.apple.com/iphone ibm.com/topics siemens.com/company bosch.com/careers
"""
LABELLED = tuple((u, 1) for u in BLOCKED.split()) + tuple((u, 0) for u in ALLOWED.split())


def url_part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(url_part(url, r"^(?s).*?://([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, url_part(url, r"^(?s).*?://[^/?#]*([^?#]*)")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def ngrams(host: str, path: str, sizes=(3, 4, 5), buckets: int = 1 << 14) -> np.ndarray:
    """Distinct hashed character n-grams of ``^host$``, without a leading ``www.``, and ``^path$``, told apart."""
    out = set()
    for mark, s in (("h", f"^{host.removeprefix('www.')}$"), ("p", f"^{path}$")):
        for n in sizes:
            for i in range(max(1, len(s) - n + 1)):
                out.add(zlib.crc32((mark + s[i : i + n]).encode("utf-8", "surrogatepass")) % buckets)
    return np.fromiter(sorted(out), "i8")


@lru_cache(maxsize=4)
def train(labelled=LABELLED, buckets: int = 1 << 14, ridge: float = 0.002, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias: gradient descent on the ridge-penalised logistic loss; rows have unit length."""
    grams, y = [ngrams(*_cut(u), buckets=buckets) for u, _ in labelled], np.array([y for _, y in labelled], float)
    sizes = np.array([len(g) for g in grams])
    at, starts, unit = np.concatenate(grams), np.cumsum(sizes) - sizes, 1 / np.sqrt(sizes)
    w, bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(np.add.reduceat(w[at], starts) * unit + bias))) - y) / len(y)
        w -= 4.0 * (ridge * w / len(y) + np.bincount(at, np.repeat(e * unit, sizes), buckets))
        bias -= e.sum()
    return w, bias


def _cut(u: str) -> tuple[str, str]:
    host, slash, path = u.partition("/")
    return host, slash + path


def probability(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    w, bias = model
    at = ngrams(host, path, buckets=len(w))
    return float(1 / (1 + np.exp(-(w[at].sum() / np.sqrt(len(at)) + bias))))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every page's url.  No shuffle."""
    host, path = host_and_path(F.col("url").cast("string"))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    model = train(labelled)  # once, here: its size is that of ``buckets``

    def scored(batches):
        for b in batches:
            p = [probability(h, x, model) for h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=["page_id", "host", "path", "score"])

    out = rows.mapInArrow(scored, f"page_id {kind}, host string, path string, score double")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
