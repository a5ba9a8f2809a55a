"""A small labelled URL table, written by hand: whole addresses of invented sites as they are met, unwanted and wanted ones.

Fixed values: what a reader of such a list would block (gambling, pills, adult pages, trackers, link farms, cracked software,
phishing, clickbait, dubious loans, replicas) and what not, of the same forms: long and short, with numbers, dates and queries.
"""

BLOCK = """
https://www.casino-royal77.com/slots/free-spins
http://bet365bonus.example.info/odds/live
https://poker-stars-win.net/en/deposit?bonus=200
http://online-slots-jackpot.biz/
https://luckyroulette.io/play/now
http://m.sportsbetting-tips24.com/parlay
https://freebets-today.org/claim
http://blackjack-vegas.example.com/real-money
https://lotto-winner-prize.com/claim.php?id=8812
http://megajackpots.example.net/bingo/777
https://wettbonus-sport.de/gutschein
http://cheap-pills-online.com/viagra-100mg
https://rx-pharmacy24.net/cialis/no-prescription
http://buy-tramadol-now.example.org/order
https://weightloss-miracle-pills.com/keto-burn
http://canadian-drugstore.biz/xanax
https://potenzmittel-rezeptfrei.example.de/levitra
http://steroids4sale.example.com/anabolic/
https://diet-pill-secret.net/?aff=991
http://male-enhancement-xl.info/trial
https://hot-adult-cams.com/live/girls
http://xxx-tube-free.net/videos/4411
https://sexdating-tonight.example.com/meet
http://escort-service-city.org/vip
https://pornhd-stream.example.io/watch?v=77
http://nude-celebs-pics.com/gallery/12
https://adult-friend-chat.net/signup
http://milfvideos.example.info/page/2
https://erotik-kontakte.example.de/heute
http://camgirls-xx.biz/room/9
https://ads.trackclick-media.com/r?cid=991&z=33
http://adserver77.example.net/banner/728x90.js
https://pixel.ad-tracking.io/collect.gif
http://popunder-ads.biz/serve.php?zone=12
https://click.affiliate-network24.com/go/8812
http://doubleadclick.example.com/adj/site
https://trk.adclix.net/redirect?offer=552
http://banners.adfarm1.example.org/show
https://sponsored-content-feed.com/widget.js
http://cpm-traffic-exchange.biz/surf
http://seo-backlinks-cheap.com/10000-links
https://link-farm-directory.example.net/submit
http://free-article-spinner.org/spin
https://buy-followers-likes.com/instagram
http://spamlist-mailer.example.biz/blast
https://linkdir4u.example.info/category/9/page/44
http://autoblog-network.com/scraped/feed
https://guestpost-marketplace.biz/da50
http://web-traffic-bot.net/hits
https://doorway-pages.example.com/cheap-hotels-cheap
http://full-crack-keygen.com/photoshop-serial
https://warez-downloads.net/nulled/themes
http://torrent-movies-hd.org/download/1080p.torrent
https://cracked-games-repack.example.com/free
http://serial-keys-activator.biz/windows-10
https://nulledscripts.example.io/wordpress-plugins
http://mp3-free-download-full-album.com/rar
https://apk-mod-unlimited-coins.net/hack
http://piratestream.example.org/watch-free-movies
https://keygenz.example.info/patch.exe
http://secure-paypa1-login.com/verify/account
https://bank-account-verify.example.net/update.php?user=1
http://appleid-locked-support.com/unlock
https://login-microsofft.example.com/office365/signin
http://webmail-quota-upgrade.biz/confirm
https://amaz0n-prize-giveaway.net/survey
http://crypto-wallet-restore.example.org/seed-phrase
https://irs-refund-claim.com/form
http://netfl1x-billing-update.info/card
https://dhl-parcel-fee.example.com/pay/track
http://you-wont-believe-this.com/celebrity-shocking
https://viral-clickbait-buzz.net/10-tricks-doctors-hate
http://shocking-secret-revealed.example.com/one-weird-trick
https://celebgossip-leaks.biz/unseen
http://miracle-cure-they-hide.org/story
https://get-rich-quick-crypto.com/double-your-bitcoin
http://forex-robot-profit.net/signals
https://payday-loan-fast-cash.com/apply
http://instant-cash-advance.example.org/no-credit-check
https://work-from-home-millions.biz/join
http://binary-options-guru.example.com/vip
https://schnell-kredit-ohne-schufa.example.de/antrag
http://replica-watches-shop.com/rolex-fake
https://fake-designer-handbags.net/gucci-replica
http://cheap-rayban-outlet.biz/sale-90-off
https://counterfeit-notes.example.org/euro
http://essay-writing-cheap.com/buy-essay
https://buy-diploma-online.net/degree
http://free-iphone-winner.example.com/congratulations
https://claim-gift-card-now.com/survey?step=1
""".split()

ALLOW = """
https://www.gazette-north.com/2021/05/council-approves-budget
http://news.harbourtown.org/local/schools-reopen
https://dailyreview.example.com/politics/4412.html
http://www.morgenblatt.de/wirtschaft/artikel/2210
https://lejournal-ouest.fr/culture/theatre-festival
http://elmundo-local.es/deportes/final-de-copa
https://weather.coastguard.example.org/forecast/week
http://radio4west.example.net/programme/archive
https://press.museum-city.org/releases/2019
http://thechronicle.example.io/opinion/letters
https://en.openpedia.org/wiki/Photosynthesis
http://docs.numlib.dev/en/stable/reference/array.html
https://developer.webplatform.org/docs/css/grid
http://manual.dbserver.org/12/sql-select.html
https://stackquestions.example.com/questions/118823/how-to-sort-a-list
http://git.projecthost.net/tools/parser/blob/main/README.md
https://packages.linuxbase.org/main/libxml2
http://mathworld-notes.example.edu/linear-algebra/ch3
https://physics.uni-valley.edu/courses/phys101/syllabus
http://cs.techuniversity.example.ac/~mueller/teaching
https://library.stateuniversity.edu/catalog/item/88213
http://archive.textproject.org/ebooks/1342
https://journals.openscience.org/biology/article/view/552
http://arxiv-mirror.example.org/abs/2101.00001
https://www.ministry-health.gov/vaccination/schedule
http://data.cityportal.gov/dataset/bus-stops
https://www.bundesamt-statistik.de/tabellen/bevoelkerung
http://service-public.example.fr/demarches/passeport
https://www.ayuntamiento-sur.es/tramites/empadronamiento
http://parliament.example.uk/debates/1998-11-02
https://www.family-recipes.com/lentil-soup
http://bakinghome.example.net/bread/sourdough-starter
https://gardenguide.org/vegetables/tomatoes-from-seed
http://www.kochbuch-online.de/rezepte/apfelkuchen
https://cuisine-maison.example.fr/recettes/ratatouille
http://hikingtrails.example.org/routes/lake-loop
https://citywalks.travel/lisbon/old-town
http://trains-timetable.example.com/station/central
https://camping-am-see.example.de/preise
http://birdwatchers.example.net/sightings/heron
https://www.childrens-hospital.org/patients/visiting-hours
http://pharmacology.uni-valley.edu/lectures/antibiotics
https://dental-care-info.org/brushing
http://first-aid.redbadge.example.org/burns
https://mental-health-support.org/helpline
http://nutrition.school-meals.example.gov/guidelines
https://www.runnersclub.example.com/training/marathon-plan
http://yoga-basics.example.net/poses/tree
https://footballarchive.org/season/1974/results
http://chess-club-hamilton.example.com/tournaments/2018
https://www.localbakery.example.com/menu
http://bikes-and-parts.com/repair/brakes
https://shop.woodtoys.example.de/produkt/eisenbahn
http://bookshop-corner.example.org/new-arrivals
https://furniture-makers.net/chairs/oak
http://www.plumber-smith.example.co/contact
https://hotel-zur-post.example.at/zimmer
http://vineyards-south.example.fr/visites
https://instrument-store.com/guitars/acoustic-beginners
http://photo-prints.example.io/sizes
https://blog.anna-writes.com/2016/11/autumn-notes
http://mike-builds-things.example.net/post/garden-shed
https://notes.theteacher.org/classroom/fractions
http://travelling-family.example.com/day-12-crossing-the-pass
https://blog.softwarecraft.dev/testing-without-mocks
http://poetry-corner.example.org/poems/winter
https://oldmaps.history-society.org/county/1840
http://genealogy-records.example.net/parish/baptisms
https://railway-museum.example.co/exhibits/steam
http://astronomy-club.example.org/observing/saturn-rings
https://forum.woodworkers.example.com/thread/2291/page/3
http://forum.linuxhelp.net/viewtopic.php?t=4410
https://community.homebrewers.example.org/t/yeast-question/812
http://parents-board.example.com/topic/school-lunch
https://qa.gardeners.example.io/q/when-to-prune-roses
http://maps.openstreets.org/way/10229
https://translate-dictionary.example.com/de-en/haus
http://grammar-exercises.example.net/past-tense/2
https://learn-spanish-free.org/lesson/14
http://kidsscience.example.org/experiments/volcano
https://podcasts.storyhour.example.com/episode/88
http://filmreviews.example.net/1957/courtroom-drama
https://concerthall.example.org/season/tickets
http://artgallery-north.example.com/exhibition/landscapes
https://www.theatre-royal.example.uk/whats-on
http://charity-food-bank.org/donate-goods
https://volunteer-firebrigade.example.de/einsatz/2020
http://church-of-st-mary.example.org/services
https://scouts-district9.example.net/calendar
http://www.animal-shelter.example.com/adopt/dogs
""".split()
