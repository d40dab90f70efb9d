"""The labelled URLs from which the URL filter learns: kinds of sites that a text corpus does without, and ordinary ones.

Hosts of the first list are made up; host names are what a split into folds goes by.
"""

BLOCKED = """
https://www.mega-casino-slots.example/bonus/free-spins
http://royalvegas-roulette.example/play?aff=221
https://bestpokerbets.example/en/texas-holdem-jackpot
https://online-gambling-tips.example/blackjack/win-real-money
https://sportsbook-odds24.example/bet/football
https://luckyspin777.example/slots/jackpot
http://bingo-cash-prizes.example/register
https://crypto-casino.example/dice/bet-btc
https://lottery-winner-claim.example/prize?id=88
https://betting-exchange.example/odds/tennis
http://freepornvideos.example/watch/18231
https://xxx-tube-hd.example/videos/milf
https://hot-adult-cams.example/live/girls
https://sexchat-tonight.example/rooms/18plus
https://nude-pics-gallery.example/album/33
https://escort-dating-night.example/city/berlin
http://hentai-manga-xxx.example/read/7
https://camgirls-webcam.example/show
https://adult-hookup-finder.example/signup
https://erotic-stories-xxx.example/story/12
https://buy-viagra-cheap.example/pills/order
http://canadian-pharmacy-meds.example/cialis-no-prescription
https://discount-xanax-online.example/buy
https://weight-loss-miracle-pills.example/keto-gummies
https://buy-oxycodone-overnight.example/checkout
https://steroids-shop.example/anabolic/order
https://cheap-meds-rx.example/tramadol
https://male-enhancement-pills.example/offer?c=9
https://viagra-generic-store.example/cart
https://herbal-potency-cure.example/buy-now
http://torrent-cracks.example/photoshop-keygen.exe
https://warez-downloads.example/full-version-crack
https://serialz-keygen.example/windows/activator
https://free-movies-streaming-hd.example/watch-online-free
https://piratebay-proxy.example/torrent/9912
https://nulled-scripts.example/themes/nulled
https://cracked-games-repack.example/download/setup.exe
https://apk-mod-unlimited.example/hack/coins
https://leaked-albums-rar.example/download
https://iptv-premium-cheap.example/m3u/list
http://paypal-login-verify.example/account/confirm
https://secure-bank-update.example/signin.php?session=77
https://appleid-unlock-support.example/verify/identity
http://netflix-billing-problem.example/update-payment
https://amazon-giftcard-winner.example/claim
https://microsoft-alert-virus.example/call-support
http://account-suspended-notice.example/login/index.php
https://wallet-connect-validate.example/seed-phrase
https://tax-refund-portal.example/claim/form.php
https://parcel-fee-pending.example/track/pay
http://malware-dropper.example/payload/update.exe
https://fake-antivirus-scan.example/scanner/threats
https://exploit-kit-landing.example/gate.php
http://botnet-panel.example/admin/bots
https://ransom-decryptor.example/pay/bitcoin
https://keylogger-spy-app.example/download
https://hacked-accounts-shop.example/dumps/cvv
https://ddos-booter-stresser.example/plans
https://carding-forum.example/fullz/cvv
https://phishing-kit-store.example/kits
https://get-rich-quick-system.example/secret
https://bitcoin-doubler.example/invest/profit
https://forex-signals-guaranteed.example/vip
https://work-from-home-cash.example/earn-5000-week
https://crypto-pump-signals.example/airdrop/free
https://binary-options-robot.example/autotrade
https://payday-loans-instant.example/no-credit-check
https://debt-relief-spam.example/apply?src=mail
https://pyramid-income.example/join/matrix
https://free-iphone-giveaway.example/survey
http://spam-link-farm.example/links/page99.html
https://cheap-replica-watches.example/rolex/sale
https://buy-followers-likes.example/instagram/10k
https://essay-mill-writers.example/order/cheap-essay
https://seo-backlinks-pack.example/buy/5000-links
https://clickbait-shocking-news.example/you-wont-believe
https://fake-passport-documents.example/order/id
https://psychic-love-spells.example/black-magic
https://penny-auctions-scam.example/bid
https://coupon-popups-ads.example/redirect?u=abc
"""
ALLOWED = """
https://www.wikipedia.org/wiki/Photosynthesis
https://en.wikipedia.org/wiki/History_of_bread
https://de.wikipedia.org/wiki/Alpen
https://fr.wikipedia.org/wiki/Chateau
https://www.gutenberg.org/ebooks/1342
https://archive.org/details/texts
https://www.bbc.co.uk/news/science-environment
https://www.theguardian.com/books/reviews
https://www.lemonde.fr/culture/article/cinema
https://www.spiegel.de/wissenschaft/mensch
https://elpais.com/cultura/libros.html
https://www.reuters.com/world/europe
https://apnews.com/hub/weather
https://www.nature.com/articles/research
https://www.sciencemag.org/journals
https://arxiv.org/abs/1706.03762
https://pubmed.ncbi.nlm.nih.gov/12345678/
https://www.nasa.gov/mission/voyager
https://www.esa.int/Science_Exploration
https://www.noaa.gov/climate/data
https://www.who.int/health-topics
https://www.un.org/en/about-us
https://europa.eu/european-union/law
https://www.gov.uk/browse/education
https://www.loc.gov/collections/maps
https://www.mit.edu/education/courses
https://www.stanford.edu/research
https://www.ox.ac.uk/admissions/graduate
https://www.uni-heidelberg.de/de/studium
https://www.sorbonne-universite.fr/formations
https://www.khanacademy.org/math/algebra
https://www.coursera.org/learn/machine-learning
https://ocw.mit.edu/courses/physics
https://www.britannica.com/animal/dog
https://www.merriam-webster.com/dictionary/word
https://dictionary.cambridge.org/grammar
https://www.imdb.com/title/tt0111161/
https://github.com/apache/spark/pulls
https://gitlab.com/gnome/gtk/issues
https://stackoverflow.com/questions/11227809
https://docs.python.org/3/library/re.html
https://spark.apache.org/docs/latest/sql-ref.html
https://www.postgresql.org/docs/current/index.html
https://developer.mozilla.org/en-US/docs/Web/HTML
https://www.rust-lang.org/learn
https://go.dev/doc/tutorial
https://kubernetes.io/docs/concepts
https://www.kernel.org/doc/html
https://www.debian.org/releases/stable
https://pypi.org/project/numpy/
https://www.allrecipes.com/recipe/soup
https://www.seriouseats.com/baking-bread-guide
https://www.marmiton.org/recettes/tarte
https://www.chefkoch.de/rezepte/kuchen
https://www.rhs.org.uk/plants/roses
https://www.gardenersworld.com/how-to/grow-plants
https://www.nationalparks.org/explore/hiking
https://www.lonelyplanet.com/france/paris
https://www.openstreetmap.org/map
https://www.metoffice.gov.uk/weather/forecast
https://www.weather.gov/forecast/maps
https://www.museodelprado.es/en/the-collection
https://www.louvre.fr/en/visit
https://www.britishmuseum.org/collection/galleries
https://www.metmuseum.org/art/collection
https://www.nhm.ac.uk/discover/dinosaurs.html
https://www.smithsonianmag.com/history
https://www.nationalgeographic.com/animals/mammals
https://www.economist.com/finance-and-economics
https://www.ft.com/markets/bonds
https://www.imf.org/en/Publications
https://data.worldbank.org/indicator/population
https://www.census.gov/data/tables
https://www.oecd.org/education/report
https://www.nhs.uk/conditions/asthma
https://www.mayoclinic.org/diseases-conditions
https://www.redcross.org/volunteer
https://www.unicef.org/children/education
https://www.fifa.com/worldcup/teams
https://www.olympics.com/en/sports/athletics
https://www.chess.com/learn/openings
https://www.nytimes.com/section/technology
https://www.wsj.com/business/retail
https://www.theatlantic.com/ideas/archive
https://www.goodreads.com/book/show/5107
https://www.librarything.com/work/1234
https://www.songfacts.com/category/folk
https://www.classicfm.com/composers/bach
https://www.mathworld.wolfram.com/Prime.html
https://plato.stanford.edu/entries/ethics
"""
#: Ordinary sites with names that say nothing, by a rule: first and second part, language, number.
PLAIN = [
    f"https://{sub}{a}{b}.example/{lang}/{17 * n}"
    for n, (a, b, lang, sub) in enumerate(
        (a, b, lang, sub) for a in ("north", "blue", "than", "hill") for b in ("river", "stone", "ther", "works") for lang, sub in (("en", ""), ("de", "blog."), ("fr", "m."), ("es", "shop."))
    )
]
_LISTED = [(u, blocked) for text, blocked in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split()]
#: The listed hosts once more, with a path that says nothing: it is the name that tells.
_BARE = [("/".join(u.split("/")[:3]) + f"/{('en', 'de', 'fr', 'es')[n % 4]}/{31 * n}", blocked) for n, (u, blocked) in enumerate(_LISTED)]
#: (url, 1 where blocked)
LABELLED: list[tuple[str, int]] = [*_LISTED, *_BARE, *[(u, 0) for u in PLAIN]]
