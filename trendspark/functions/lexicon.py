"""Word lists, weights and domains that results depend on."""

# Words that carry no topic.
STOP_WORDS = """a an the and or but if of in on at to for from by with without about into over under after before
is are was were be been being am do does did has have had will would can could should may might must
this that these those it its it's he she they them their his her our your you we i me my mine us
what which who whom whose when where why how not no yes so than too very just also more most less
new news via vs vs. says said say amid after as up out off all any each every other some such only
own same here there then now today tonight yesterday week year years day days first last next top
best how-to update live watch video photo photos report reports one two three get gets got make makes""".split()

# Sources in declaration order, with the weight of a source's percentile.
SOURCE_WEIGHTS = {
    "google_trends": 1.00,
    "hackernews": 0.95,
    "google_news": 0.90,
    "x_trends24": 0.85,
    "wikipedia": 0.80,
    "reddit": 0.80,
    "github": 0.75,
    "producthunt": 0.65,
    "tiktok": 0.60,
    "ai_papers": 0.70,
    "arxiv": 0.55,
}
DEFAULT_WEIGHT = 0.6
SOURCES = list(SOURCE_WEIGHTS)
SOCIAL = ["reddit", "x_trends24", "tiktok"]

# Token pattern of titles.
TOKEN = r"[a-z0-9][a-z0-9'+.&-]*[a-z0-9+]|[a-z0-9]"

# Momentum by velocity, from the top; the first bound that holds names it.
MOMENTUM = [(75, "SURGING"), (60, "RISING"), (40, "STEADY"), (25, "COOLING")]

# Lookback windows in hours and their weights.
WINDOWS = [(1.0, 0.5), (6.0, 0.3), (24.0, 0.2)]

# The stage at which each reason of discard applies.
STAGE_OF_REASON = {"R": "clean", "A": "budget", "N": "cluster"}

# Subreddits and hashtags that carry no trend.
LOW_SIGNAL_SUBREDDITS = """aww cats dogs rarepuppers eyebleach pics mildlyinteresting oddlysatisfying memes me_irl meirl
2meirl4meirl funny wholesomememes animalsbeingderps animalsbeingbros animalsbeingjerks pets husky
corgi catsareassholes blackcats tuxedocats standardissuecat selfie amiugly roastme aitah amitheasshole
tifu relationship_advice askreddit nostupidquestions askmen askwomen showerthoughts unpopularopinion
confession offmychest trueoffmychest facepalm therewasanattempt mademesmile humansbeingbros
pic itookapicture earthporn food foodporn gardening houseplants""".split()
GENERIC_HASHTAGS = """fyp foryou foryoupage fy fypage fypシ viral viralvideo trending trend trend2026 explore explorepage
tiktok tiktokviral capcut duet stitch fall autumn fallvibes autumnvibes falloutfit fallfashion fallseason
fallaesthetic pumpkinspice pumpkin cozy cozyseason sweaterweather spookyseason spooky halloweencostume
summer summervibes winter winteroutfit spring springvibes love fashion ootd grwm makeup skincare beauty
funny comedy humor cute aesthetic music dance dancechallenge song lyrics motivation inspiration
goodmorning goodnight morning mood vibes vibe weekend weekendvibes friday fridayvibes fridayfeeling
monday mondaymotivation tuesday wednesday thursday saturday sunday sundayfunday tbt throwbackthursday
happy smile life lifestyle family friends couple relationship food foodie recipe cooking fitness gym
workout travel nature photography art artist fyppppppppppppppppppppppp xyzbca xyzcba greenscreen
learnontiktok booktok pov relatable""".split()

# Patterns of titles and headlines.
GENERIC_HASHTAG = (
    r"(?:happy|good)(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekend|morning|night)\w*"
    r"|(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekend)(?:vibes|motivation|feeling|funday|mood|mornings?)?"
    r"|\w*(?:vibes|szn|aesthetic|ootd|grwm)"
)
ANECDOTE = (
    r"^(?:my|i|i'm|im|i've|ive|i'd|i'll|me|we|we're|we've|our|us|mine|meet my|look at (?:my|this|our)|"
    r"just (?:got|found|finished|made|saw)|finally (?:got|finished|made)|so i|today i|yesterday i|"
    r"this is my|here'?s my|when you|when your|me when|mfw|mrw|tfw|pov:?)\b"
    r"|\bmy (?:cat|dog|wife|husband|son|daughter|boyfriend|girlfriend|bf|gf|mom|mum|dad|grandma|grandpa|"
    r"kid|kids|baby|partner|friend|neighbor|neighbour|boss|coworker|roommate|first|new)\b"
    r"|\b(?:tifu|aita|aitah|wibta|til i|iama|ama)\b"
)
MEME_PHOTO = (
    r"\b(?:meme|memes|selfie|pic of|photo of|picture of|pics of|took this|i drew|i painted|my (?:drawing|painting|art)|"
    r"fan ?art|wallpaper|cute|adorable|wholesome|caturday|shower thoughts?|unpopular opinion|rate my|roast me|"
    r"any ideas\??|help me|what is this|who is this|does anyone|anyone else|is it just me)\b"
)
PET = (
    r"\b(?:cats?|kittens?|kitty|dogs?|doggo|puppy|puppies|pupper|pups?|good boy|good girl|hamster|bunny|"
    r"parrot|goldfish|pet|pets|furbaby|fur baby)\b"
)
BOX_SCORE = (
    r"\b(?:box score|player props?|prop bets?|parlays?|same game parlay|sgp|fantasy (?:football|points|lineup|"
    r"start|sit|team)|start[/ ]sit|waiver wire|injury report|odds|point spread|spread pick|over/under|"
    r"betting lines?|best bets?|picks? (?:and|&) predictions?|prediction[s]?,? odds|final score|live score|"
    r"how to watch|live stream|where to watch|what channel|tv channel|kickoff time|start time)\b"
    r"|\b\d+\s*(?:pts|reb|ast|yds|rec|tds?)\b.*\b\d+\s*(?:pts|reb|ast|yds|rec|tds?)\b"
)
CATEGORY_PREFIX = (
    r"^\s*(?:sports?|entertainment|tech(?:nology)?|news|internet culture|culture|science\s*(?:&|and)\s*ai|"
    r"science|ai|world|business|politics)\s*[:|\-]\s+"
)
INSUFFICIENT = r"\[?\s*insufficient[\s_-]*data\s*\]?"
GENERIC_HEADLINE_WORDS = """advances advancements developments development events event news updates update tools tool
innovations innovation music film films movies global economy economic weather trends trend trending
industry technology tech science research ai world sports entertainment culture various latest
highlights roundup recap headlines diplomacy politics business markets market stories story topics
mixed miscellaneous other others several multiple key major new products product launches
productivity learning dynamics optimization models""".split()
#: Sources whose titles are held against the anecdote rule, and those free of the box-score rule.
ANECDOTE_SOURCES = [*SOCIAL, "google_news"]
NO_BOX_SCORE_SOURCES = ["arxiv", "ai_papers", "github"]

# Categories, and other names for each in the order in which they are looked for.
CATEGORIES = ["Sports", "Entertainment", "Tech", "News", "Internet Culture", "Science & AI"]
CATEGORY_ALIASES = {
    "Sports": ["sports", "sport", "athletics"],
    "Entertainment": ["entertainment", "movies", "film", "tv", "television", "music", "gaming", "games", "celebrity"],
    "Tech": ["tech", "technology", "software", "hardware", "developer", "programming", "cybersecurity", "security"],
    "News": ["news", "politics", "world", "world news", "business", "finance", "economy", "weather", "crime", "health"],
    "Internet Culture": ["internet culture", "internet", "culture", "memes", "meme", "social media", "viral", "lifestyle"],
    "Science & AI": ["science & ai", "science and ai", "science/ai", "science", "ai", "artificial intelligence", "research", "space", "machine learning"],
}

# Names of sources as shown.
SOURCE_DISPLAY = {
    "x_trends24": "X",
    "reddit": "Reddit",
    "tiktok": "TikTok",
    "google_trends": "Google Trends",
    "google_news": "Google News",
    "wikipedia": "Wikipedia",
    "arxiv": "arXiv",
    "ai_papers": "AI Papers of the Week",
    "hackernews": "Hacker News",
    "github": "GitHub",
    "producthunt": "Product Hunt",
}

# Patterns taken out of titles, headlines and summaries.
CLICKBAIT = (
    r"^\s*(?:breaking(?: news)?|just in|watch|update|updated|exclusive|developing|live|video|photos?|"
    r"must[- ]see|viral|shocking|omg|wow)\s*[:\-|!]+\s*"
    r"|\[(?:oc|video|photo|pic|pics|serious|nsfw|meta|update|removed)\]"
    r"|\((?:video|photos?|watch|pics?|oc)\)"
    r"|\b(?:you won'?t believe|will blow your mind|goes viral|gone viral|jaw[- ]dropping|must[- ]see|"
    r"what happened next|here'?s why|this is why|the internet is losing it|broke the internet|"
    r"can'?t stop watching|mind[- ]blowing|insane|unbelievable)\b[:!.,]*"
)
MD_LINK = r"\[([^\]]{1,200})\]\((?:https?://|www\.)[^)]*\)"
SAFE_URL = r"(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)\]]"
BARE_URL = r"(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|org|net|io|ai|dev|app|co)(?:/\S*)?"
TRAILING_URL = r"[\s(\[<:-]*(?:(?:https?://|www\.)\S+[\s)\]>.,;]*)+$"
HANDLE = r"(?<![\w@])@([A-Za-z0-9_]{2,30})\b"
JSON_KEY = r'"?\b(?:headline|summary|category|item_ids|primary_entities|relevance_score|clusters|discarded_item_ids)\b"?\s*:\s*'
JSON_FRAGMENT = r'"\s*,\s*"[^"]{0,60}"?|"\s*:\s*"?'
JSON_JUNK = r'\\[nrt"]|[{}\[\]`]|(?<=\s)"\s*,\s*"|^\s*"|"\s*,?\s*$'
SMALL_WORDS = "a an and as at but by for from in into nor of on or over per the to up via vs vs. with".split()
PROPER_WORDS = """Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July
August September October November December""".split()
FILLER = (
    r"\b(?:no (?:specific|further|additional|detailed) (?:information|details)|details (?:are|remain) (?:scarce|unclear|limited)|"
    r"(?:not|in)sufficient (?:information|context|data|details)|not enough (?:information|context|details)|"
    r"limited information|information is limited|unclear why|it is unclear (?:what|why)|cannot (?:be )?determine[d]?|"
    r"no (?:clear|further) context|without (?:more|further|additional) (?:information|context))\b"
)

# Names in titles, words that are no names, and last words too common to stand for one.
PROPER_NOUN = r"\b([A-Z][A-Za-z0-9&'.-]+(?:\s+(?:of|the|de|&)?\s*[A-Z][A-Za-z0-9&'.-]+){0,3})"
ENTITY_BLOCKLIST = ["The", "A", "An", "This", "That", "New", "Why", "How", "What", "Show", "Ask", "Launch", "HN"]
GENERIC_ENTITY_TOKENS = """nfl nba mlb nhl ai news game team city state united states world
new york north south east west university national international open""".split()

# Paragraphs of pages that say nothing, the shortest that counts, and where sources have their context.
BOILERPLATE = (
    r"(cookie|subscribe|sign up|sign in|log in|newsletter|javascript|enable js|accept all|privacy policy|"
    r"all rights reserved|advertisement|skip to (main )?content|you have been blocked|access denied|"
    r"are you a robot|captcha|checking your browser)"
)
MIN_PARAGRAPH = 60
NO_PAGE_SOURCES = ["x_trends24", "tiktok"]
FEED_CONTEXT_SOURCES = ["arxiv", "ai_papers", "producthunt"]

# The order in which categories are preferred on equal votes, references to ranks, and tickets.
PREFERRED = ["Sports", "Science & AI", "Tech", "Entertainment", "News", "Internet Culture"]
TREND_REF = r"(?:#\s*|\btrend\s+|\bnumber\s+|\bno\.\s*)(\d{1,2})\b"
CLAIMABLE = ["todo", "in_progress"]
PRIORITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# The stage of each reason of discard, and sentences of summaries.
DISCARD_STAGES = {
    "reddit_low_signal_subreddit": "clean",
    "reddit_low_engagement": "clean",
    "reddit_unverified_metrics": "clean",
    "hn_low_points": "clean",
    "github_low_stars": "clean",
    "generic_hashtag": "clean",
    "too_short_or_non_ascii": "clean",
    "personal_anecdote": "clean",
    "meme_or_photo": "clean",
    "pet_post": "clean",
    "box_score_or_betting": "clean",
    "no_signal_tokens": "clean",
    "not_selected_budget": "select",
    "density_noise": "cluster",
    "unsupported_grouping": "cluster",
    "insufficient_data": "cluster",
    "low_relevance": "cluster",
    "weak_singleton": "cluster",
}
INSUFFICIENT_FLAG = "[INSUFFICIENT_DATA]"
CARRY = ("is carrying", "are carrying")
SIGNALS = ("related signal about", "related signals about")
OPENING = " is drawing attention across trend sources."
CLOSING_MANY = ("The story is trending across ", " at the same time.")
CLOSING_ONE = " is currently driving attention to the story."

#: Fixed value: addresses that lead on to another page.
REDIRECTS = "news.google.com"
