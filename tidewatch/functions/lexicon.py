"""Fixed values of post scoring: word weights, correction patterns, segment categories, coins, bots.

They decide results and are plain values, to be replaced by a deployment's own lists through the parameters of
``functions.posts``. Patterns are matched without regard to case unless stated.
"""

#: Term and weight; terms match as substrings of the lower-cased text.
WEIGHTS = [
    ("moon", 3.0), ("mooning", 3.5), ("bullish", 2.5), ("hodl", 2.0), ("hodling", 2.0), ("diamond hands", 2.5), ("diamondhands", 2.5), ("to the moon", 3.0), ("ttm", 2.5), ("ath", 1.5),
    ("breakout", 2.0), ("pumping", 2.0), ("pump", 1.5), ("accumulate", 1.5), ("accumulating", 1.5), ("undervalued", 1.5), ("bullrun", 3.0), ("bull run", 3.0), ("lambo", 2.0), ("wagmi", 2.5),
    ("lfg", 2.0), ("gm", 0.5), ("based", 1.5), ("alpha", 1.0), ("gem", 1.5), ("100x", 2.0), ("10x", 1.5), ("gains", 1.5), ("profit", 1.5), ("profitable", 1.5),
    ("bearish", -2.5), ("rekt", -3.0), ("rug", -3.5), ("rugpull", -4.0), ("rug pull", -4.0), ("rugged", -4.0), ("dump", -2.5), ("dumping", -2.5), ("crashed", -3.0), ("crash", -2.5), ("crashing", -3.0),
    ("scam", -4.0), ("scammer", -4.0), ("scammers", -4.0), ("ponzi", -4.0), ("paper hands", -1.5), ("paperhands", -1.5), ("sell off", -2.0), ("selloff", -2.0), ("bloodbath", -3.0), ("capitulation", -3.0),
    ("ngmi", -2.5), ("honeypot", -3.5), ("exploit", -2.5), ("exploited", -3.0), ("hack", -2.5), ("hacked", -3.0), ("drain", -2.5), ("drained", -3.0), ("liquidated", -3.0), ("liquidation", -2.5),
    ("rekted", -3.0), ("bag holder", -2.0), ("bagholder", -2.0), ("bagholding", -2.0), ("dead", -2.0), ("dying", -2.5), ("plunge", -2.5), ("plunging", -2.5), ("tank", -2.0), ("tanking", -2.5),
    ("bleeding", -2.0), ("bleed", -1.5), ("loss", -1.5), ("losses", -2.0), ("lost", -1.5), ("down bad", -2.5), ("expensive", -1.5), ("overpriced", -2.0), ("fees", -0.5), ("high fees", -1.5), ("slow", -1.0),
    ("broken", -2.0), ("buggy", -2.0), ("unusable", -2.5), ("terrible", -3.0), ("horrible", -3.0), ("awful", -3.0), ("worst", -3.0), ("sucks", -2.5), ("disappointing", -2.0), ("disappointed", -2.0),
    ("frustrating", -2.0), ("frustrated", -2.0), ("annoying", -1.5), ("annoyed", -1.5), ("useless", -2.5), ("waste", -2.0), ("unable", -1.5), ("cannot", -1.0), ("can't", -1.0), ("won't", -1.0),
    ("doesn't work", -2.0), ("not working", -2.0), ("warning", -0.5), ("beware", -1.5), ("careful", -0.5), ("caution", -0.5), ("risk", -1.0), ("risky", -1.5), ("dangerous", -2.0), ("avoid", -1.5), ("stay away", -2.0),
    ("fud", -1.5), ("fomo", 1.0), ("whale", 0.5), ("dip", -0.5), ("buying the dip", 1.5), ("btfd", 1.5), ("correction", -1.0), ("consolidation", 0.0), ("crab", 0.0), ("crabbing", 0.0), ("altseason", 2.0), ("alt season", 2.0),
    ("proposal", 0.0), ("approve", 0.0), ("approval", 0.0), ("allocate", 0.0), ("allocation", 0.0), ("treasury", 0.0), ("liquidity", 0.0), ("governance", 0.0), ("vote", 0.0), ("voting", 0.0), ("delegate", 0.0), ("fund", 0.0), ("funding", 0.0),
]

#: Pattern and what it adds to the score, times 0.3 in sum.
CORRECTIONS = [
    (r"\b(down|dropped|fell|lost|crashed)\s+\d+(\.\d+)?%", -2.0), (r"\b(down|dropped|fell)\s+(about\s+)?\d+(\.\d+)?%", -2.0), (r"\bis\s+down\b", -1.0), (r"\b(red|bleeding|dumping)\s+(day|week|month)", -1.5),
    (r"\b(issues?\s+(?:with|i've|i have|we have))", -1.5), (r"\b(problem(?:s)?\s+(?:with|is|are))", -1.5), (r"\b(unable\s+to)", -1.5), (r"\b(can't|cannot|couldn't)\s+(?:seem\s+to\s+)?(?:get|make|find|use|access)", -1.5),
    (r"\b(doesn't|don't|won't)\s+(?:work|support|allow)", -2.0), (r"\b(too\s+(?:expensive|slow|complicated|difficult))", -2.0), (r"\b(waste\s+of\s+(?:time|money))", -2.5), (r"\b(not\s+(?:worth|working|good|great|impressed))", -1.5),
    (r"\b(one\s+of\s+the\s+(?:worst|biggest\s+problems))", -2.5), (r"\bwarning\s*:", -1.0), (r"\b(beware|watch\s+out|stay\s+away|be\s+careful)", -1.5), (r"\b(protect\s+(?:yourself|your\s+(?:crypto|funds|wallet)))", -0.5),
    (r"\bnever\s+(?:trust|share|send|click)", -1.0), (r"^(?:is|are|can|does|do|has|have|should|would|will)\s+.+\?$", -0.3), (r"\?$", -0.2),
    (r"\b(just\s+(?:bought|accumulated|added))", 1.5), (r"\b(finally\s+(?:broke|passed|hit))", 1.5), (r"\b(congrat(?:s|ulations))", 2.0), (r"\b(let'?s\s+(?:go|goooo))", 2.0),
    (r"\b(this\s+is\s+(?:huge|massive|bullish|amazing))", 2.0), (r"\b(love\s+(?:this|it))", 1.5), (r"\b(great\s+(?:news|project|team))", 1.5),
]

#: Categories of segments, first match wins; the rest is STANDARD.
CATEGORIES = [
    ("FILTER", [r"\bi am a bot\b", r"\bautomod(erator)?\b", r"\bperformed automatically\b", r"\bcontact the moderators\b", r"^⚠️?\s*WARNING", r"^WARNING:?\s*(IMPORTANT)?", r"^PSA.*SCAM", r"Please read.*wiki", r"NEWBIES GUIDE", r"PROJECT CATALYST", r"This comment\s+logs the Pay2Post"]),
    ("ACTIVITY", [r"\bscam(mer)?s?\b", r"\bprotect your (crypto|funds|wallet)\b", r"\bstay safe\b", r"\bphishing\b", r"\brug\s?pull(ed)?\b", r"\bfraud(ulent)?\b", r"\bsuspicious\b", r"\bdo not trust\b", r"\bnever (give|share|send)\b"]),
    ("TRUE_BEARISH", [r"\bi lost \$?\d+", r"\blost (my |all |everything)", r"\bgot (rekt|liquidated|rugged|scammed)", r"\bgoing to zero\b", r"\bdone with crypto\b", r"\bshould have sold\b", r"\bpanic sell", r"\bbleeding (out|money)", r"\bwiped out\b", r"\bcapitulat", r"\bgive up\b", r"\bregret (buying|holding)"]),
    ("EUPHORIA", [r"\bto the moon\b", r"\b\d+x (incoming|guaranteed|easy)", r"\bcan't lose\b", r"\blast chance\b", r"\bgoing all in\b", r"\btook out (a )?loan\b", r"\blambo\b", r"\bmillionaire\b", r"\beasy money\b", r"\bfree money\b", r"\bnot financial advice but\b", r"\btrust me\b", r"\bguaranteed\b"]),
]

#: Coins by pattern, case as written.
COINS = [
    ("BTC", r"\bBTC\b|\b[Bb]itcoin\b"), ("ETH", r"\bETH\b|\b[Ee]thereum\b"), ("SOL", r"\bSOL\b|\b[Ss]olana\b"), ("BNB", r"\bBNB\b|\b[Bb]inance\s*[Cc]oin\b"), ("XRP", r"\bXRP\b|\b[Rr]ipple\b"), ("ADA", r"\bADA\b|\b[Cc]ardano\b"), ("DOGE", r"\bDOGE\b|\b[Dd]oge\s*[Cc]oin\b"),
    ("AVAX", r"\bAVAX\b|\b[Aa]valanche\b"), ("DOT", r"\bDOT\b|\b[Pp]olkadot\b"), ("MATIC", r"\bMATIC\b|\b[Pp]olygon\b"), ("LINK", r"\bLINK\b|\b[Cc]hainlink\b"), ("UNI", r"\bUNI\b|\b[Uu]niswap\b"), ("ATOM", r"\bATOM\b|\b[Cc]osmos\b"), ("LTC", r"\bLTC\b|\b[Ll]itecoin\b"),
]

#: Words that make a thread relevant.
TOPIC = (
    r"\b(bitcoin|btc|ethereum|eth|solana|sol|xrp|ripple|cardano|ada|dogecoin|doge|litecoin|ltc|polkadot|dot|avax|matic|polygon|link|chainlink|bnb|pepe|shib"
    r"|crypto|cryptocurrency|altcoin|defi|nft|hodl|wagmi|ngmi|gm|bull\s*run|bear\s*market|moon|pump|dump|rug|staking|yield|airdrop|binance|coinbase|kraken"
    r"|metamask|ledger|wallet|blockchain|web3|l1|l2|memecoin|shitcoin|100x|1000x)\b"
)

#: Authors whose comments do not count; so do not those whose name ends in "bot".
BOTS = [
    "AutoModerator", "RemindMeBot", "sneakpeekbot", "WikiSummarizerBot", "RepostSleuthBot", "ImagesOfNetwork", "TweetPoster", "bot", "donut-bot", "coinfeeds-bot", "Bitty_Bot", "ModToolBot", "MoonsModBot", "moons_bot", "lntipbot",
    "Banano_Tipbot", "changetip", "TipBotLite", "pepetipbot", "dca-bot", "WikiTextBot", "haikusbot", "Shakespeare-Bot", "alphabet_order_bot", "wikipedia_answer_bot", "GoodBot_BadBot", "totes_meta_bot", "timee_bot", "the_timezone_bot",
]

#: English function words, as Spark's own stop-word remover lists them (those of two letters or more, without apostrophes).
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just don "
    "should now cannot could ought would"
).split()
