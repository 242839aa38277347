"""A small labelled URL table for the filter's model: written by hand, from general knowledge of what URLs look like.

Fixed values: (url, 1 for block). Blocked: gambling, adult content, drug sales, piracy, loans and fake prizes, advertising and tracking
services, phishing look-alikes and link farms. Allowed: newspapers, schools, public services, museums, recipes, software, shops, health,
sport, and invented names that mean nothing, as most hosts' names don't. Endings and schemes are the same mix on both sides, so a model has to go by the words.
"""

from __future__ import annotations

BLOCKED = """
http://www.royal-casino-online.com/slots/bonus
https://jackpotcity-casino.net/play-now?aff=991
https://luckyspins-slots.org/free-spins/register
http://bestpokerroom.com/texas-holdem/real-money
https://online-betting-odds.net/live/football/bet
https://sportsbet-bonus.org/free-bet/claim
http://megaroulette.info/en/winbig
https://bingo-bonus-codes.com/2021/top-50
https://vegas-slot-machines.net/download/win.html
http://winnersclub-lottery.org/you-won/prize.php
https://www.xxxvideos-hot.com/watch/12345
https://adult-webcams-live.net/girls/online
http://hotsexchat.org/join/free
https://freepornclips.info/tube/page/7
https://escort-agency-city.com/models/vip
http://adultdatingfinder.net/singles/nearby
https://sexy-singles-tonight.org/signup
https://xxx-adult-movies.com/category/all
http://cheap-viagra-pharmacy.net/order/no-prescription
https://discount-pills-online.org/buy/cialis
https://canadian-pharmacy-meds.info/cheap/xanax
http://buy-tramadol-overnight.com/checkout
https://weightloss-miracle-pills.net/order-now
https://dietpills-cheap.org/offer/50off
http://steroids4sale.com/shop/cart
https://replica-watches-cheap.net/rolex/sale
https://fake-designer-bags.org/louis/outlet
http://cheapest-sunglasses-outlet.info/raybans/90off
https://torrent-movies-hd.com/download/full
https://warez-crack-keygen.net/serial/photoshop
http://free-mp3-downloads-full.org/album/rip
https://watch-series-free-stream.com/ep/1
https://crackedgames-download.net/setup.exe
http://keygenserials.org/activation/code
https://payday-loans-instant.info/apply/bad-credit
https://quickcash-loan-approval.com/no-check
http://cheap-insurance-quotes-now.net/form
https://creditrepair-fast.org/offer/free
https://bitcoin-doubler-profit.com/invest/now
http://forex-robot-millionaire.net/signals
https://crypto-giveaway-bonus.org/claim/eth
https://makemoney-fromhome-fast.info/secret
http://get-rich-quick-system.com/video
https://free-iphone-winner.net/survey/claim
https://giftcard-generator-free.org/amazon
http://congratulations-you-won.com/prize/visitor
https://surveys-rewards-claim.net/step/1
https://paypal-account-verify-login.org/secure/update.php
http://appleid-security-confirm.info/signin/verify
https://bank-login-secure-update.com/account/confirm
https://netfl1x-billing-update.net/payment/verify
http://microsoft-support-alert.org/virus/call-now
https://your-pc-is-infected-scan.com/fix/download.exe
https://secure-webmail-login-verify.net/owa/index.php
http://adserver.banner-exchange.org/click?id=77
https://ads.popunder-network.info/serve/js
https://tracking-pixel-analytics.com/collect?uid=1
http://clicktracker-affiliate.net/redir/go
https://trk.adclicks-delivery.org/imp/pixel.gif
https://popads-redirect.com/landing/2
http://doubleads-traffic.net/buy/visitors
https://bannerfarm-clicks.org/ad/frame.html
https://cpa-offers-tracker.info/aff_c?offer_id=3
http://spyware-toolbar-install.com/get/setup.exe
https://linkfarm-directory-submit.net/add/url
https://backlinks-cheap-seo.org/buy/10000
http://spamblog-autopost.com/article/keyword
https://best-cheap-keywords-4u.net/tag/buy-online
https://buy-followers-likes.org/instagram/1000
http://mass-email-blaster.info/lists/buy
https://spammail-lists-leads.com/download
https://articlespinner-seo-bot.net/spin
http://click-here-free-gift.org/win/iphone
https://hot-deals-cheap-cheap.com/sale/sale
https://win-free-money-daily.net/spin/wheel
http://instant-lotto-winner.org/ticket/free
https://casino-royale-vip.info/en/bonus
https://freebetting-tips-win.com/de/tipps
http://betking-odds.net/fr/paris
https://pokerstars-freeroll.org/es/jugar
https://pillstore-discount.com/de/kaufen
http://camgirls-xxx.net/es/chat
https://adtrack-metrics-pixel.org/fr/collect
https://sexshop-adult-toys.info/en/sale
http://grand-prize-giveaway.com/claim/iphone
https://free-gift-cards-now.net/survey/start
http://you-have-won.org/congratulations/collect
https://instant-payday-loan.com/apply/no-credit-check
http://quick-cash-advance.net/approval/today
https://debt-relief-miracle.org/consolidate/now
http://crypto-doubler.net/invest/guaranteed-profit
https://bitcoin-trader-secret.com/millionaire/robot
http://forex-signals-vip.org/join/telegram
https://binary-options-profit.net/strategy/win-every-time
http://work-from-home-riches.com/earn/5000-a-week
https://pyramid-income-system.net/referral/bonus
http://secure-paypa1-login.com/verify/account
https://appleid-unlock-support.net/signin/confirm
http://bank-account-update.org/security/alert
https://amaz0n-refund-center.com/claim/order
http://netflix-billing-renew.net/payment/update
https://microsoft-virus-warning.org/call/helpline
http://login-facebook-verify.com/session/expired
https://parcel-redelivery-fee.net/pay/tracking
http://download-cracked-software.com/keygen/serial
https://warez-full-version.net/activator/patch
http://free-movie-streams.org/watch/hd/online
https://torrent-megapack.com/download/bluray
http://mp3-download-free.net/album/zip
https://nulled-scripts.org/wordpress/theme
http://game-hacks-cheats.com/aimbot/undetected
https://unlimited-coins-generator.net/hack/android
http://replica-watches-outlet.com/rolex/cheap
https://fake-designer-bags.net/gucci/sale
http://cheap-sneakers-wholesale.org/replica/buy
https://diet-pills-miracle.com/lose-weight/fast
http://testosterone-booster-trial.net/free/bottle
https://buy-steroids-online.org/anabolic/shop
http://no-prescription-meds.com/tramadol/overnight
https://male-enhancement-pills.net/order/discount
http://hair-growth-secret.com/buy/one-get-one
https://seo-backlinks-cheap.com/buy/1000-links
http://link-exchange-farm.net/directory/submit
https://article-spinner.org/autoblog/traffic
http://buy-followers-fast.com/instagram/likes
https://traffic-exchange-bot.net/clicks/boost
http://ad-tracker-pixel.com/track/click?id=77
https://popunder-network.net/ads/serve?zone=12
http://banner-exchange-media.com/adserver/rotate
https://redirect-offers.net/go?aff=3321
http://clickbank-affiliate-offers.org/track?sub=9
https://push-notification-ads.com/subscribe/allow
http://live-cam-girls.org/chat/private
https://nude-celebrity-pics.net/gallery/leaked
http://milf-dating-local.com/meet/tonight
https://erotic-stories-xxx.org/read/hot
http://online-roulette-bonus.net/deposit/match
https://blackjack-real-money.com/play/instant
http://slot-reels-daily.org/spin/win
https://sports-betting-tips.net/odds/guaranteed
http://poker-freeroll-codes.com/bonus/no-deposit
https://horse-racing-bets.org/wager/live
http://lottery-numbers-predictor.net/win/jackpot
https://scratch-cards-casino.com/instant/prize
"""

ALLOWED = """
http://www.daily-herald-news.com/politics/2023/05/election-results
https://morningpost.net/world/europe/article-4471
https://news.riverside-tribune.org/local/council-meeting
http://lemondeinfo.com/culture/cinema/critique
https://www.zeitung-heute.net/wirtschaft/bericht
https://elperiodico-sur.org/deportes/liga
http://www.state-university.info/physics/courses/101
https://library.oldtown.com/catalogue/search
https://springfield-school.net/calendar/term-dates
http://open-courseware.org/mathematics/linear-algebra/notes
https://www.natural-history-museum.com/exhibitions/dinosaurs
https://nationalgallery-arts.net/collection/paintings/17
http://city-council.org/services/waste-collection
https://www.health-ministry.info/vaccination/schedule
https://weather-service.com/forecast/northern-region
http://parliament-records.net/debates/1998/march
https://courts.justice.org/decisions/appeal/2011
https://en.encyclopedia-open.com/wiki/Photosynthesis
http://dictionary-words.net/define/serendipity
https://plants-database.org/species/quercus-robur
https://birdwatchers-society.info/sightings/heron
http://garden-almanac.com/vegetables/tomatoes/planting
https://grandmas-kitchen.net/recipes/apple-pie
https://bread-and-butter-blog.org/sourdough/starter
http://www.mountain-hiking.com/trails/alps/day-3
https://travel-notes.net/italy/florence/what-to-see
https://railway-timetables.org/stations/central
http://cyclists-union.info/routes/coast
https://football-history.com/clubs/1950/season
https://chess-academy.net/openings/sicilian
http://marathon-runners.org/training/plan-10k
https://docs.python-tutorials.com/library/itertools
https://developer.linux-handbook.net/kernel/scheduler
http://opensource-projects.org/repository/issues/42
https://forum.programmers-help.info/questions/8812/sorting
https://blog.database-internals.com/btree/pages
http://statistics-for-all.net/regression/intro
https://astronomy-pictures.org/archive/nebula
https://space-agency.com/missions/mars/rover
http://journal-of-biology.net/volume/12/issue/3/article
https://medical-review.org/cardiology/guidelines
https://clinic-heartcare.info/patients/appointments
http://childrens-hospital.com/departments/surgery
https://www.old-books-archive.net/texts/moby-dick/chapter-1
https://poetry-corner.org/poets/keats/autumn
http://theatre-royal.com/whats-on/hamlet
https://symphony-orchestra.net/concerts/season
https://folk-music-archive.org/songs/scotland
http://film-institute.info/reviews/silent-era
https://photographers-guild.com/gallery/landscape
https://handmade-pottery.net/shop/mugs
http://corner-bookshop.org/new-titles/history
https://bicycle-repairs.com/services/prices
https://furniture-workshop.net/tables/oak
http://village-bakery.org/menu/cakes
https://organic-farmers-market.info/vegetables/season
https://dairy-farming-today.com/cattle/feeding
http://community-garden.net/volunteer
https://animal-shelter.org/adopt/dogs
https://wildlife-trust.com/reserves/marsh
http://climate-research.net/data/temperature
https://energy-agency.org/reports/solar
https://economics-letters.info/inflation/analysis
http://consumer-advice.com/rights/returns
https://legal-guide.net/contracts/tenancy
https://genealogy-records.org/parish/1840
http://local-history-society.com/maps/canal
https://philosophy-notes.net/kant/critique
https://language-exchange.org/spanish/grammar/verbs
http://deutsch-lernen.info/de/grammatik/dativ
https://cuisine-francaise.com/fr/recettes/soupe
https://viajes-y-rutas.net/es/andalucia/granada
http://kindergarten-ideas.org/crafts/paper
https://parents-forum.com/sleep/toddlers
https://knitting-patterns.net/scarves/wool
http://woodland-walks.org/autumn/leaves
https://www.national-gallery.com/collection/painters/turner
http://www.city-library.com/catalogue/search/history
https://linux-kernel-docs.com/admin-guide/filesystems
https://python-tutorials.com/lessons/dictionaries
http://river-levels.com/stations/thames
https://railway-timetable.org/routes/north
https://parliament-record.com/debates/2016/march
http://county-court.com/forms/appeal
https://tax-office.net/guidance/self-employed
http://driving-licence.org/renewal/documents
https://passport-service.net/appointments
https://public-health.org/vaccines/schedule
http://university-press.com/journals/physics/volume-12
https://dept-of-chemistry.com/courses/organic
https://medieval-studies.com/manuscripts/charter
http://astronomy-club.com/observing/jupiter
https://birdwatchers.com/species/wren
https://geology-museum.net/minerals/quartz
http://ancient-history.net/rome/senate
https://poetry-archive.net/poets/keats
https://chess-federation.com/tournaments/results
http://rowing-club.net/fixtures/regatta
https://marathon-training.org/plans/beginner
http://village-football.com/league/table
https://hill-walking.info/peaks/ridge
https://cycling-routes.com/coast/map
http://camping-guide.com/sites/lake
https://sailing-school.net/courses/weekend
https://opera-house.org/season/tickets
http://string-quartet.org/concerts/autumn
https://film-institute.net/archive/silent
https://theatre-company.net/auditions
http://photography-society.net/exhibitions/landscape
https://pottery-studio.org/classes/glazing
https://bread-baking.org/sourdough/starter
http://vegetarian-kitchen.org/recipes/lentils
https://tea-merchants.org/black/assam
https://cheese-makers.net/varieties/cheddar
http://bookbinding-supplies.net/leather/thread
https://garden-tools.net/spades/steel
http://bicycle-parts.org/brakes/cables
https://hardware-store.com/paint/brushes
https://second-hand-books.org/fiction/classics
http://toy-museum.net/trains/history
https://primary-school.com/term/dates
http://nursery-rhymes.org/lullabies
https://maths-olympiad.net/problems/geometry
https://debating-society.net/motions/archive
http://weather-records.com/rainfall/1987
https://earthquake-survey.net/events/recent
https://ocean-institute.net/currents/atlantic
http://forestry-commission.net/trees/oak
https://beekeepers.net/hives/winter
http://veterinary-college.org/research/horses
https://hospital-trust.org/departments/cardiology
http://dental-association.com/advice/children
https://fire-brigade.net/safety/alarms
https://volunteer-lifeboats.com/stations
http://newspaper-archive.com/editorials/1969
https://radio-drama.net/episodes/list
https://encyclopedia-articles.com/wiki/lighthouse
http://translators-forum.net/glossary/legal
https://statistics-bureau.net/census/households
http://fair-trade-shop.org/coffee/beans
https://www.allotment-society.org/plots/waiting-list
http://rail-museum.com/locomotives/steam
https://court-records.net/judgments/civil
http://choir-festival.com/programme/evening
https://carpenters-guild.com/apprentices
http://archaeology-field.com/digs/bronze-age
http://velmora.net/en/home
https://norvik.org/about
https://tirano.com/es/inicio
http://quandel.net/fr/page/3
https://ostrava-kent.org/2019/07
https://lumbert.info/p/4471
http://brixwell.com/de/seite/12
https://marenko.net/contact
https://zentria.org/en/archive/88
http://calloway.com/index.html
https://pellucid.net/notes/5
https://hartwin.org/team
http://oberland.info/de/1204
https://tessaly.com/fr/318
https://rondavel.net/posts/2020
http://kirnan.org/es/77
https://amberlane.com/view/9
https://solvane.net/help
http://dunmarrow.org/news/31
https://ferrolite.info/products/list
https://ninesen.com/en/2051
http://tarlind.net/en/616
https://wexmere.org/story/14
https://orlanth.com/es/4302
"""


def rows() -> list[tuple[str, int]]:
    """(url, label): 1 for block, 0 for allow."""
    return [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
