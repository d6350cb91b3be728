"""Fixed values.

Places: country, state and city patterns in matching order.

These strings decide results, so they are stated exactly and in matching order.
"""

from . import Rule

US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY", "DC", "PR",
]

US_STATE_NAMES = (
    r"\b(alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|"
    r"georgia|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|louisiana|maine|maryland|"
    r"massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|"
    r"new hampshire|new jersey|new mexico|new york|north carolina|north dakota|ohio|oklahoma|"
    r"oregon|pennsylvania|rhode island|south carolina|south dakota|tennessee|texas|utah|"
    r"vermont|virginia|washington|west virginia|wisconsin|wyoming)\b"
)

US_MARKERS = (
    r"\b(united states|usa|u\.s\.a?\.?|us based|(remote|nationwide)[\s,\-–]*(us|usa)|(us|"
    r"usa)[\s,\-–]*(remote|nationwide)|nationwide remote|remote nationwide)\b"
)

US_CITIES = (
    r"\b(san francisco|new york city|nyc\b|los angeles|chicago|houston|philadelphia|phoenix|"
    r"san antonio|san diego|san jose|austin|jacksonville|fort worth|columbus|charlotte|"
    r"indianapolis|seattle|denver|washington,? d\.?c\.?|boston|nashville|detroit|"
    r"oklahoma city|portland|las vegas|memphis|louisville|baltimore|milwaukee|albuquerque|"
    r"tucson|fresno|sacramento|mesa|kansas city|atlanta|omaha|colorado springs|raleigh|"
    r"virginia beach|long beach|oakland|minneapolis|tulsa|arlington|tampa|new orleans|"
    r"santa clara|sunnyvale|mountain view|palo alto|menlo park|redmond|bellevue|cupertino|"
    r"pittsburgh|cincinnati|st\.? louis|salt lake city|boulder|ann arbor|madison|durham|"
    r"chapel hill|scottsdale|plano|irvine|santa monica|brooklyn|manhattan|queens|bronx)\b"
)

COUNTRY_NAMES = [
    (r"\b(united kingdom|england|scotland|wales|great britain|\buk\b)\b", "GB"),
    (r"\b(ireland|republic of ireland)\b", "IE"),
    (r"\bindia\b", "IN"),
    (r"\b(philippines|filipino)\b", "PH"),
    (r"\bmalaysia\b", "MY"),
    (r"\bsingapore\b", "SG"),
    (r"\b(canada|ontario|quebec|british columbia|alberta)\b", "CA"),
    (r"\b(germany|deutschland)\b", "DE"),
    (r"\bfrance\b", "FR"),
    (r"\b(spain|espa[nñ]a)\b", "ES"),
    (r"\b(netherlands|holland)\b", "NL"),
    (r"\bbelgium\b", "BE"),
    (r"\bitaly\b", "IT"),
    (r"\bportugal\b", "PT"),
    (r"\bpoland\b", "PL"),
    (r"\bromania\b", "RO"),
    (r"\b(czech|czechia)\b", "CZ"),
    (r"\bhungary\b", "HU"),
    (r"\baustria\b", "AT"),
    (r"\bswitzerland\b", "CH"),
    (r"\bsweden\b", "SE"),
    (r"\bdenmark\b", "DK"),
    (r"\bnorway\b", "NO"),
    (r"\bfinland\b", "FI"),
    (r"\baustralia\b", "AU"),
    (r"\bnew zealand\b", "NZ"),
    (r"\bjapan\b", "JP"),
    (r"\b(china|prc)\b", "CN"),
    (r"\b(hong kong)\b", "HK"),
    (r"\btaiwan\b", "TW"),
    (r"\b(south korea|korea)\b", "KR"),
    (r"\bvietnam\b", "VN"),
    (r"\bthailand\b", "TH"),
    (r"\bindonesia\b", "ID"),
    (r"\bisrael\b", "IL"),
    (r"\b(united arab emirates|\buae\b|dubai|abu dhabi)\b", "AE"),
    (r"\bsaudi\b", "SA"),
    (r"\begypt\b", "EG"),
    (r"\bsouth africa\b", "ZA"),
    (r"\bkenya\b", "KE"),
    (r"\bnigeria\b", "NG"),
    (Rule((r"\bmexico\b",), strip=r"\bnew\smexico\b"), "MX"),
    (r"\bbrazil\b", "BR"),
    (r"\bargentina\b", "AR"),
    (r"\bcolombia\b", "CO"),
    (r"\bchile\b", "CL"),
    (r"\bcosta rica\b", "CR"),
    (r"\b(lithuania|vilnius|kaunas)\b", "LT"),
    (r"\b(latvia|riga)\b", "LV"),
    (r"\b(estonia|tallinn|tartu)\b", "EE"),
    (r"\b(ukraine|kyiv|kiev|lviv|kharkiv|odesa|odessa)\b", "UA"),
    (r"\b(slovakia|bratislava|kosice)\b", "SK"),
    (r"\b(slovenia|ljubljana)\b", "SI"),
    (r"\b(bulgaria|sofia|plovdiv|varna)\b", "BG"),
    (r"\b(greece|athens|thessaloniki)\b", "GR"),
    (r"\b(serbia|belgrade|novi sad)\b", "RS"),
    (r"\b(croatia|zagreb|split)\b", "HR"),
    (r"\b(bosnia|sarajevo)\b", "BA"),
    (r"\b(north macedonia|skopje)\b", "MK"),
    (r"\b(albania|tirana)\b", "AL"),
    (r"\bmoldova\b", "MD"),
    (r"\b(cyprus|nicosia|limassol)\b", "CY"),
    (r"\bmalta\b", "MT"),
    (r"\b(iceland|reykjavik)\b", "IS"),
    (r"\bluxembourg\b", "LU"),
    (r"\b(turkey|t[uü]rkiye|istanbul|ankara|izmir)\b", "TR"),
    (r"\b(peru|lima)\b", "PE"),
    (r"\b(uruguay|montevideo)\b", "UY"),
    (r"\bparaguay\b", "PY"),
    (r"\bbolivia\b", "BO"),
    (r"\b(ecuador|quito|guayaquil)\b", "EC"),
    (r"\bvenezuela\b", "VE"),
    (r"\bpanam[aá]\b", "PA"),
    (r"\bguatemala\b", "GT"),
    (r"\bhonduras\b", "HN"),
    (r"\b(dominican republic|santo domingo)\b", "DO"),
    (r"\b(morocco|casablanca|rabat)\b", "MA"),
    (r"\b(tunisia|tunis)\b", "TN"),
    (r"\bghana\b", "GH"),
    (r"\buganda\b", "UG"),
    (r"\b(jordan|amman)\b", "JO"),
    (r"\b(qatar|doha)\b", "QA"),
    (r"\bkuwait\b", "KW"),
    (r"\bbahrain\b", "BH"),
    (r"\boman\b", "OM"),
    (r"\b(pakistan|karachi|lahore|islamabad)\b", "PK"),
    (r"\b(bangladesh|dhaka)\b", "BD"),
    (r"\bsri lanka\b", "LK"),
    (r"\bnepal\b", "NP"),
    (r"\b(cambodia|phnom penh)\b", "KH"),
]

CITY_COUNTRY = [
    (r"\b(bengaluru|bangalore|hyderabad|pune|chennai|noida|gurgaon|gurugram|mumbai|new delhi|delhi|kolkata|ahmedabad|coimbatore|trivandrum|thiruvananthapuram|kochi|cochin|indore|jaipur|nagpur|vadodara|bhubaneswar|mysore|mysuru|chandigarh|trichy|tiruchirappalli|visakhapatnam|vizag|lucknow|kanpur|surat|bhopal|vijayawada|madurai|thane|navi mumbai|whitefield)\b", "IN"),
    (r"\b(manila|makati|cebu|taguig|quezon city)\b", "PH"),
    (r"\b(kuala lumpur|penang|cyberjaya)\b", "MY"),
    (r"\b(london|manchester|edinburgh|glasgow|bristol|leeds|birmingham)\b", "GB"),
    (r"\b(dublin|cork|galway|limerick)\b", "IE"),
    (r"\b(toronto|vancouver|montreal|calgary|ottawa|waterloo)\b", "CA"),
    (r"\b(berlin|munich|münchen|hamburg|frankfurt|cologne|stuttgart|düsseldorf)\b", "DE"),
    (r"\b(paris|toulouse|lyon|bordeaux|nantes|lille|roanne|rennes)\b", "FR"),
    (r"\b(madrid|barcelona|valencia|seville)\b", "ES"),
    (r"\b(amsterdam|rotterdam|utrecht|eindhoven)\b", "NL"),
    (r"\b(warsaw|krakow|kraków|wroclaw|gdansk)\b", "PL"),
    (r"\b(bucharest|cluj|timisoara|iasi)\b", "RO"),
    (r"\b(prague|brno)\b", "CZ"),
    (r"\b(budapest|debrecen)\b", "HU"),
    (r"\b(sydney|melbourne|brisbane|perth|canberra)\b", "AU"),
    (r"\b(tokyo|osaka|kyoto)\b", "JP"),
    (r"\b(tel aviv|jerusalem|haifa|herzliya)\b", "IL"),
    (r"\b(sao paulo|são paulo|rio de janeiro)\b", "BR"),
    (r"\b(mexico city|guadalajara|monterrey)\b", "MX"),
    (r"\b(san jose, costa rica|heredia)\b", "CR"),
    (r"\b(zurich|zürich|geneva|basel|lausanne)\b", "CH"),
    (r"\b(stockholm|gothenburg)\b", "SE"),
    (r"\b(copenhagen|aarhus)\b", "DK"),
    (r"\b(oslo|bergen)\b", "NO"),
    (r"\b(lisbon|porto)\b", "PT"),
    (r"\b(milan|rome|turin)\b", "IT"),
    (r"\b(brussels|antwerp|ghent)\b", "BE"),
    (r"\b(vienna|graz)\b", "AT"),
    (r"\b(shanghai|beijing|shenzhen|guangzhou)\b", "CN"),
    (r"\b(seoul|busan)\b", "KR"),
    (r"\b(ho chi minh|hanoi|da nang)\b", "VN"),
    (r"\b(bangkok)\b", "TH"),
    (r"\b(jakarta|bandung)\b", "ID"),
]

US_STATE_NAME_TO_CODE = [
    (r"\bwest virginia\b", "WV"),
    (r"\bnew hampshire\b", "NH"),
    (r"\bnew jersey\b", "NJ"),
    (r"\bnew mexico\b", "NM"),
    (r"\bnew york\b", "NY"),
    (r"\bnorth carolina\b", "NC"),
    (r"\bsouth carolina\b", "SC"),
    (r"\bnorth dakota\b", "ND"),
    (r"\bsouth dakota\b", "SD"),
    (r"\brhode island\b", "RI"),
    (r"\bdistrict of columbia\b", "DC"),
    (r"\balabama\b", "AL"),
    (r"\balaska\b", "AK"),
    (r"\barizona\b", "AZ"),
    (r"\barkansas\b", "AR"),
    (r"\bcalifornia\b", "CA"),
    (r"\bcolorado\b", "CO"),
    (r"\bconnecticut\b", "CT"),
    (r"\bdelaware\b", "DE"),
    (r"\bflorida\b", "FL"),
    (r"\bgeorgia\b", "GA"),
    (r"\bhawaii\b", "HI"),
    (r"\bidaho\b", "ID"),
    (r"\billinois\b", "IL"),
    (r"\bindiana\b", "IN"),
    (r"\biowa\b", "IA"),
    (r"\bkansas\b", "KS"),
    (r"\bkentucky\b", "KY"),
    (r"\blouisiana\b", "LA"),
    (r"\bmaine\b", "ME"),
    (r"\bmaryland\b", "MD"),
    (r"\bmassachusetts\b", "MA"),
    (r"\bmichigan\b", "MI"),
    (r"\bminnesota\b", "MN"),
    (r"\bmississippi\b", "MS"),
    (r"\bmissouri\b", "MO"),
    (r"\bmontana\b", "MT"),
    (r"\bnebraska\b", "NE"),
    (r"\bnevada\b", "NV"),
    (r"\bohio\b", "OH"),
    (r"\boklahoma\b", "OK"),
    (r"\boregon\b", "OR"),
    (r"\bpennsylvania\b", "PA"),
    (r"\btennessee\b", "TN"),
    (r"\btexas\b", "TX"),
    (r"\butah\b", "UT"),
    (r"\bvermont\b", "VT"),
    (r"\bvirginia\b", "VA"),
    (r"\bwashington\b", "WA"),
    (r"\bwisconsin\b", "WI"),
    (r"\bwyoming\b", "WY"),
    (r"\bpuerto rico\b", "PR"),
]

CITY_STATE_US = [
    (r"\b(seattle|bellevue|redmond|kirkland|tacoma|spokane|spokane valley|bellingham|olympia|everett|renton|bothell|sammamish|issaquah|puyallup|federal way|lynnwood|kennewick|yakima|walla walla|bremerton|mountlake terrace|maple valley)\b", "WA"),
    (r"\b(new york city|nyc|brooklyn|manhattan|the bronx|bronx)\b", "NY"),
    (r"\b(san francisco|los angeles|san diego|san jose|sacramento|oakland|palo alto|mountain view|menlo park|sunnyvale|santa clara|santa monica|cupertino|irvine|long beach|berkeley|fremont|pasadena)\b", "CA"),
    (r"\bchicago\b", "IL"),
    (r"\b(houston|san antonio|dallas|fort worth|plano|austin)\b", "TX"),
    (r"\b(phoenix|tucson|mesa|scottsdale|tempe|chandler)\b", "AZ"),
    (r"\bboston\b", "MA"),
    (r"\batlanta\b", "GA"),
    (r"\b(miami|jacksonville|tampa|orlando|fort lauderdale)\b", "FL"),
    (r"\b(denver|boulder|colorado springs)\b", "CO"),
    (r"\b(minneapolis|saint paul|st\.? paul)\b", "MN"),
    (r"\b(detroit|ann arbor)\b", "MI"),
    (r"\b(nashville|memphis)\b", "TN"),
    (r"\b(las vegas|reno)\b", "NV"),
    (r"\b(charlotte|raleigh|durham|chapel hill)\b", "NC"),
    (r"\b(columbus|cincinnati|cleveland)\b", "OH"),
    (r"\bindianapolis\b", "IN"),
    (r"\blouisville\b", "KY"),
    (r"\b(baltimore|bethesda)\b", "MD"),
    (r"\b(milwaukee|madison)\b", "WI"),
    (r"\bnew orleans\b", "LA"),
    (r"\b(oklahoma city|tulsa)\b", "OK"),
    (r"\bsalt lake city\b", "UT"),
    (r"\bomaha\b", "NE"),
    (r"\balbuquerque\b", "NM"),
    (r"\bvirginia beach\b", "VA"),
    (r"\b(philadelphia|pittsburgh)\b", "PA"),
    (r"\b(st\.? louis|saint louis)\b", "MO"),
]

COUNTRY_LABELS = {
    "US": "United States",
    "GB": "United Kingdom",
    "IE": "Ireland",
    "IN": "India",
    "PH": "Philippines",
    "MY": "Malaysia",
    "SG": "Singapore",
    "CA": "Canada",
    "DE": "Germany",
    "FR": "France",
    "ES": "Spain",
    "NL": "Netherlands",
    "BE": "Belgium",
    "IT": "Italy",
    "PT": "Portugal",
    "PL": "Poland",
    "RO": "Romania",
    "CZ": "Czechia",
    "HU": "Hungary",
    "AT": "Austria",
    "CH": "Switzerland",
    "SE": "Sweden",
    "DK": "Denmark",
    "NO": "Norway",
    "FI": "Finland",
    "AU": "Australia",
    "NZ": "New Zealand",
    "JP": "Japan",
    "CN": "China",
    "HK": "Hong Kong",
    "TW": "Taiwan",
    "KR": "South Korea",
    "VN": "Vietnam",
    "TH": "Thailand",
    "ID": "Indonesia",
    "IL": "Israel",
    "AE": "UAE",
    "SA": "Saudi Arabia",
    "EG": "Egypt",
    "ZA": "South Africa",
    "KE": "Kenya",
    "NG": "Nigeria",
    "MX": "Mexico",
    "BR": "Brazil",
    "AR": "Argentina",
    "CO": "Colombia",
    "CL": "Chile",
    "CR": "Costa Rica",
    "LT": "Lithuania",
    "LV": "Latvia",
    "EE": "Estonia",
    "UA": "Ukraine",
    "SK": "Slovakia",
    "SI": "Slovenia",
    "BG": "Bulgaria",
    "GR": "Greece",
    "RS": "Serbia",
    "HR": "Croatia",
    "BA": "Bosnia and Herzegovina",
    "MK": "North Macedonia",
    "AL": "Albania",
    "MD": "Moldova",
    "CY": "Cyprus",
    "MT": "Malta",
    "IS": "Iceland",
    "LU": "Luxembourg",
    "TR": "Turkey",
    "PE": "Peru",
    "UY": "Uruguay",
    "PY": "Paraguay",
    "BO": "Bolivia",
    "EC": "Ecuador",
    "VE": "Venezuela",
    "PA": "Panama",
    "GT": "Guatemala",
    "HN": "Honduras",
    "DO": "Dominican Republic",
    "MA": "Morocco",
    "TN": "Tunisia",
    "GH": "Ghana",
    "UG": "Uganda",
    "JO": "Jordan",
    "QA": "Qatar",
    "KW": "Kuwait",
    "BH": "Bahrain",
    "OM": "Oman",
    "PK": "Pakistan",
    "BD": "Bangladesh",
    "LK": "Sri Lanka",
    "NP": "Nepal",
    "KH": "Cambodia",
}

US_STATE_LABELS = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
    "DC": "District of Columbia",
    "PR": "Puerto Rico",
}

# The District written as the city "Washington", before the state can claim it.
DC_FORMS = [
    r"\bwashington\s*,?\s*d\.?\s*c\.?\b",
    r"\bwashington\s*,?\s*dc\b",
    r"\bdistrict of columbia\b",
    r"\bd\.?\s?c\.?[\s,\-|]+washington\b",
]
