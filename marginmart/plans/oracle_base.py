"""DuckDB SQL for the sales mart and the enrichment, shared by every oracle query.

The oracle re-derives each result from the raw star tables in a second engine; it reuses
no Spark code.  Expressions mirror the fixture definitions and the enrichment rules
(sum in decimal, divide in double, same order), so both engines give the same bits.
"""

from __future__ import annotations


# FIXED VALUES, written out here so the oracle does not depend on the code it checks: position in
# the fixture, then team, sport and state, or marketplace and tier.
LOOKUPS = """
teams(k, team, sport, state) AS (VALUES
    (1, 'Atlanta Hawks', 'NBA', 'GA'), (2, 'Boston Celtics', 'NBA', 'MA'), (3, 'Brooklyn Nets', 'NBA', 'NY'),
    (4, 'Charlotte Hornets', 'NBA', 'NC'), (5, 'Chicago Bulls', 'NBA', 'IL'),
    (6, 'Cleveland Cavaliers', 'NBA', 'OH'), (7, 'Dallas Mavericks', 'NBA', 'TX'),
    (8, 'Denver Nuggets', 'NBA', 'CO'), (9, 'Detroit Pistons', 'NBA', 'MI'),
    (10, 'Golden State Warriors', 'NBA', 'CA'), (11, 'Houston Rockets', 'NBA', 'TX'),
    (12, 'Indiana Pacers', 'NBA', 'IN'), (13, 'Los Angeles Clippers', 'NBA', 'CA'),
    (14, 'Los Angeles Lakers', 'NBA', 'CA'), (15, 'LA Clippers', 'NBA', 'CA'),
    (16, 'Memphis Grizzlies', 'NBA', 'TN'), (17, 'Miami Heat', 'NBA', 'FL'),
    (18, 'Milwaukee Bucks', 'NBA', 'WI'), (19, 'Minnesota Timberwolves', 'NBA', 'MN'),
    (20, 'New Orleans Pelicans', 'NBA', 'LA'), (21, 'New York Knicks', 'NBA', 'NY'),
    (22, 'Oklahoma City Thunder', 'NBA', 'OK'), (23, 'Orlando Magic', 'NBA', 'FL'),
    (24, 'Philadelphia 76ers', 'NBA', 'PA'), (25, 'Phoenix Suns', 'NBA', 'AZ'),
    (26, 'Portland Trail Blazers', 'NBA', 'OR'), (27, 'Sacramento Kings', 'NBA', 'CA'),
    (28, 'San Antonio Spurs', 'NBA', 'TX'), (29, 'Toronto Raptors', 'NBA', 'ON'),
    (30, 'Utah Jazz', 'NBA', 'UT'), (31, 'Washington Wizards', 'NBA', 'DC'),
    (32, 'Arizona Cardinals', 'NFL', 'AZ'), (33, 'Atlanta Falcons', 'NFL', 'GA'),
    (34, 'Baltimore Ravens', 'NFL', 'MD'), (35, 'Buffalo Bills', 'NFL', 'NY'),
    (36, 'Carolina Panthers', 'NFL', 'NC'), (37, 'Chicago Bears', 'NFL', 'IL'),
    (38, 'Cincinnati Bengals', 'NFL', 'OH'), (39, 'Cleveland Browns', 'NFL', 'OH'),
    (40, 'Dallas Cowboys', 'NFL', 'TX'), (41, 'Denver Broncos', 'NFL', 'CO'),
    (42, 'Detroit Lions', 'NFL', 'MI'), (43, 'Green Bay Packers', 'NFL', 'WI'),
    (44, 'Houston Texans', 'NFL', 'TX'), (45, 'Indianapolis Colts', 'NFL', 'IN'),
    (46, 'Jacksonville Jaguars', 'NFL', 'FL'), (47, 'Kansas City Chiefs', 'NFL', 'MO'),
    (48, 'Las Vegas Raiders', 'NFL', 'NV'), (49, 'Los Angeles Chargers', 'NFL', 'CA'),
    (50, 'Los Angeles Rams', 'NFL', 'CA'), (51, 'Miami Dolphins', 'NFL', 'FL'),
    (52, 'Minnesota Vikings', 'NFL', 'MN'), (53, 'New England Patriots', 'NFL', 'MA'),
    (54, 'New Orleans Saints', 'NFL', 'LA'), (55, 'New York Giants', 'NFL', 'NJ'),
    (56, 'New York Jets', 'NFL', 'NJ'), (57, 'Philadelphia Eagles', 'NFL', 'PA'),
    (58, 'Pittsburgh Steelers', 'NFL', 'PA'), (59, 'San Francisco 49ers', 'NFL', 'CA'),
    (60, 'Seattle Seahawks', 'NFL', 'WA'), (61, 'Tampa Bay Buccaneers', 'NFL', 'FL'),
    (62, 'Tennessee Titans', 'NFL', 'TN'), (63, 'Washington Commanders', 'NFL', 'DC'),
    (64, 'Anaheim Ducks', 'NHL', 'CA'), (65, 'Boston Bruins', 'NHL', 'MA'),
    (66, 'Buffalo Sabres', 'NHL', 'NY'), (67, 'Calgary Flames', 'NHL', 'AB'),
    (68, 'Carolina Hurricanes', 'NHL', 'NC'), (69, 'Chicago Blackhawks', 'NHL', 'IL'),
    (70, 'Colorado Avalanche', 'NHL', 'CO'), (71, 'Columbus Blue Jackets', 'NHL', 'OH'),
    (72, 'Dallas Stars', 'NHL', 'TX'), (73, 'Detroit Red Wings', 'NHL', 'MI'),
    (74, 'Edmonton Oilers', 'NHL', 'AB'), (75, 'Florida Panthers', 'NHL', 'FL'),
    (76, 'Los Angeles Kings', 'NHL', 'CA'), (77, 'Minnesota Wild', 'NHL', 'MN'),
    (78, 'Montreal Canadiens', 'NHL', 'QC'), (79, 'Nashville Predators', 'NHL', 'TN'),
    (80, 'New Jersey Devils', 'NHL', 'NJ'), (81, 'New York Islanders', 'NHL', 'NY'),
    (82, 'New York Rangers', 'NHL', 'NY'), (83, 'Ottawa Senators', 'NHL', 'ON'),
    (84, 'Philadelphia Flyers', 'NHL', 'PA'), (85, 'Pittsburgh Penguins', 'NHL', 'PA'),
    (86, 'San Jose Sharks', 'NHL', 'CA'), (87, 'Seattle Kraken', 'NHL', 'WA'),
    (88, 'St. Louis Blues', 'NHL', 'MO'), (89, 'Tampa Bay Lightning', 'NHL', 'FL'),
    (90, 'Toronto Maple Leafs', 'NHL', 'ON'), (91, 'Utah Hockey Club', 'NHL', 'UT'),
    (92, 'Utah Mammoth', 'NHL', 'UT'), (93, 'Vancouver Canucks', 'NHL', 'BC'),
    (94, 'Vegas Golden Knights', 'NHL', 'NV'), (95, 'Washington Capitals', 'NHL', 'DC'),
    (96, 'Winnipeg Jets', 'NHL', 'MB'), (97, 'Arizona Diamondbacks', 'MLB', 'AZ'),
    (98, 'Atlanta Braves', 'MLB', 'GA'), (99, 'Baltimore Orioles', 'MLB', 'MD'),
    (100, 'Boston Red Sox', 'MLB', 'MA'), (101, 'Chicago Cubs', 'MLB', 'IL'),
    (102, 'Chicago White Sox', 'MLB', 'IL'), (103, 'Cincinnati Reds', 'MLB', 'OH'),
    (104, 'Cleveland Guardians', 'MLB', 'OH'), (105, 'Colorado Rockies', 'MLB', 'CO'),
    (106, 'Detroit Tigers', 'MLB', 'MI'), (107, 'Houston Astros', 'MLB', 'TX'),
    (108, 'Kansas City Royals', 'MLB', 'MO'), (109, 'Los Angeles Angels', 'MLB', 'CA'),
    (110, 'Los Angeles Dodgers', 'MLB', 'CA'), (111, 'Miami Marlins', 'MLB', 'FL'),
    (112, 'Milwaukee Brewers', 'MLB', 'WI'), (113, 'Minnesota Twins', 'MLB', 'MN'),
    (114, 'New York Mets', 'MLB', 'NY'), (115, 'New York Yankees', 'MLB', 'NY'),
    (116, 'Athletics', 'MLB', 'CA'), (117, 'Oakland Athletics', 'MLB', 'CA'),
    (118, 'Philadelphia Phillies', 'MLB', 'PA'), (119, 'Pittsburgh Pirates', 'MLB', 'PA'),
    (120, 'San Diego Padres', 'MLB', 'CA'), (121, 'San Francisco Giants', 'MLB', 'CA'),
    (122, 'Seattle Mariners', 'MLB', 'WA'), (123, 'St. Louis Cardinals', 'MLB', 'MO'),
    (124, 'Tampa Bay Rays', 'MLB', 'FL'), (125, 'Texas Rangers', 'MLB', 'TX'),
    (126, 'Toronto Blue Jays', 'MLB', 'ON'), (127, 'Washington Nationals', 'MLB', 'DC')),
markets(k, market, tier) AS (VALUES
    (1, 'StubHub', 'Tier 1 - Major'), (2, 'SeatGeek', 'Tier 1 - Major'), (3, 'Vivid Seats', 'Tier 1 - Major'),
    (4, 'Vivid', 'Tier 1 - Major'), (5, 'TickPick', 'Tier 2 - Mid'), (6, 'Gametime', 'Tier 2 - Mid'),
    (7, 'TicketsNow', 'Tier 2 - Mid'), (8, 'Ticket Evolution', 'Tier 3 - B2B'),
    (9, 'GoTickets', 'Tier 3 - B2B'), (10, 'Expired', 'Expired/Other'))"""

MART = """
mart AS (
  SELECT
    CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01 00:00:00' THEN 'This Year' ELSE 'Last Year' END AS YearLabel,
    l_orderkey AS InvoiceID,
    CASE WHEN l_orderkey % 97 <> 0 THEN o_orderdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) END AS SellDate_dt,
    CASE WHEN l_partkey % 89 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + to_days(CAST(l_partkey % 13 * 30 AS INTEGER)) END AS EventDate_dt,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN CAST(0 AS DECIMAL(21,4))
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(21,4)) END AS SaleTotal,
    CAST(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(l_quantity AS INTEGER) AS DECIMAL(21,4)) AS TicketCost,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INTEGER) % 12 END AS Quantity,
    CASE WHEN s_suppkey % 50 <> 0 THEN s_name END AS CompanyName,
    coalesce(t.team, p_name) AS PrimaryPerformerName,
    nullif(p_brand, 'Brand#1') AS SecondaryPerformerName,
    CASE p_type WHEN 'STANDARD' THEN 38 WHEN 'PROMO' THEN 42 WHEN 'ECONOMY' THEN 43 END AS RequestedPerformerTypeId,
    coalesce(CASE p_type WHEN 'STANDARD' THEN 'NBA' WHEN 'PROMO' THEN 'NFL' WHEN 'ECONOMY' THEN 'NHL' END,
             own.sport, 'Other') AS Sport,
    own.state AS State,
    concat('Venue ', r_name) AS VenueName,
    concat(p_type, ' Night') AS EventName,
    concat(CASE l_linenumber WHEN 1 THEN 'Club ' WHEN 2 THEN 'Lot' WHEN 3 THEN 'Bal' WHEN 4 THEN 'A'
                             WHEN 5 THEN '' ELSE concat(p_name, ' ') END,
           CASE WHEN p_size < 45 THEN CAST(p_size * 10 AS VARCHAR(9)) ELSE '' END) AS Section,
    concat(CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_linenumber + 1 AS VARCHAR(9))) AS Seats,
    coalesce(m.market, c_mktsegment) AS ShippingCompany,
    coalesce(m.tier, 'Other') AS MarketplaceTier,
    o_orderpriority AS DeliveryType,
    l_linestatus = 'F' AS IsDelivered,
    l_returnflag = 'R' AS IsCancelled,
    o_orderstatus = 'P' AS IsExpired
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN teams t ON t.k = p_partkey % 140 + 1
  LEFT JOIN teams own ON own.team = coalesce(t.team, p_name)
  LEFT JOIN markets m ON m.k = c_custkey % 11 + 1
)"""


# FIXED VALUES — section keywords, written out again for the oracle.
PREMIUM_KEYWORDS = ('CLUB', 'CLB', 'LOGE', 'SUITE', 'VIP', 'PREMIUM', 'BOX', 'FLOOR', 'COURT')
LOT_KEYWORDS = ('LOT', 'GARAGE', 'PARKING', 'GOLD', 'BLACK', 'BLUE', 'YELLOW', 'EMERALD', 'RED', 'GREEN', 'PURPLE', 'ORANGE', 'SILVER', 'BRONZE', 'WHITE', 'PL')
BALCONY_KEYWORDS = ('BAL', 'BALCONY', 'MEZZ')


def _any(words) -> str:
    return "|".join(words)


STEP1 = """
e1 AS (
  SELECT *,
    SaleTotal - TicketCost AS Profit,
    Quantity AS TicketsSold,
    strftime(SellDate_dt, '%Y-%m') AS SellMonth,
    strftime(SellDate_dt, '%b') AS SellMonthName,
    CAST(month(SellDate_dt) AS INTEGER) AS SellMonthNum,
    dayname(SellDate_dt) AS SellDayOfWeek,
    CAST(hour(SellDate_dt) AS INTEGER) AS SellHour,
    strftime(EventDate_dt, '%Y-%m') AS EventMonth,
    dayname(EventDate_dt) AS EventDayOfWeek,
    CAST(floor(date_diff('microsecond', SellDate_dt, EventDate_dt) / 86400000000) AS BIGINT) AS LeadTimeDays,
    TRY_CAST(CASE WHEN array_to_string(regexp_extract_all(upper(coalesce(Section, '')), '[0-9]+'), '') = ''
                  THEN trim(split_part(coalesce(Seats, ''), '-', 1))
                  ELSE array_to_string(regexp_extract_all(upper(coalesce(Section, '')), '[0-9]+'), '') END
             AS DOUBLE) AS Section_Num,
    array_to_string(regexp_extract_all(upper(coalesce(Section, '')), '[A-Z]+'), '') AS Section_Type,
    PrimaryPerformerName AS HomeTeam,
    SecondaryPerformerName AS AwayTeam,
    CASE YearLabel WHEN 'This Year' THEN 'current' WHEN 'Last Year' THEN 'last_year' END AS YEAR
  FROM mart
)"""

STEP2 = f"""
eall AS (
  SELECT *,
    CASE WHEN SaleTotal <> 0 THEN CAST(Profit AS DOUBLE) / CAST(SaleTotal AS DOUBLE) * 100 END AS ProfitMargin,
    CASE WHEN LeadTimeDays IS NULL THEN 'Unknown'
         WHEN LeadTimeDays < 0 THEN 'Post-event sale'
         WHEN LeadTimeDays = 0 THEN 'Same day'
         WHEN LeadTimeDays <= 3 THEN '1-3 days'
         WHEN LeadTimeDays <= 7 THEN '4-7 days'
         WHEN LeadTimeDays <= 30 THEN '1-4 weeks'
         WHEN LeadTimeDays <= 90 THEN '1-3 months'
         ELSE '3+ months' END AS LeadTimeBucket,
    CASE WHEN Section_Num IS NULL OR isnan(Section_Num) THEN 'Unknown'
         WHEN Section_Num < 100 THEN 'Floor / Low (<100)'
         WHEN Section_Num < 200 THEN 'Lower Bowl (100s)'
         WHEN Section_Num < 300 THEN 'Mid Level (200s)'
         WHEN Section_Num < 400 THEN 'Upper Mid (300s)'
         ELSE 'Upper Deck (400s+)' END AS SectionNumTier,
    CASE WHEN Section_Type = '' THEN 'Numeric Only'
         WHEN regexp_matches(Section_Type, '{_any(PREMIUM_KEYWORDS)}') THEN 'Premium / Suite / Club'
         WHEN regexp_matches(Section_Type, '{_any(LOT_KEYWORDS)}') THEN 'Parking / Lot'
         WHEN regexp_matches(Section_Type, '{_any(BALCONY_KEYWORDS)}') THEN 'Balcony'
         WHEN length(Section_Type) <= 2 THEN 'Lettered (A/B/C…)'
         ELSE 'Other Named' END AS SectionTypeTier,
    CASE WHEN TicketsSold IS NULL THEN 'Unknown'
         WHEN TicketsSold = 1 THEN 'Single'
         WHEN TicketsSold = 2 THEN 'Pair'
         WHEN TicketsSold <= 4 THEN 'Small Group (3-4)'
         WHEN TicketsSold <= 8 THEN 'Group (5-8)'
         ELSE 'Large Group (9+)' END AS QuantityBucket
  FROM e1
)"""

# Every order has a label, so every enriched row is analysed.
STEP3 = """
e AS (SELECT * FROM eall)"""

PREFIX = "WITH " + ",".join([LOOKUPS, MART, STEP1, STEP2, STEP3])


def with_enriched(body: str, *extra_ctes: str) -> str:
    """``WITH mart, e1, eall, e[, extra...] body`` — ``eall`` and ``e`` are every enriched row."""
    ctes = [LOOKUPS, MART, STEP1, STEP2, STEP3, *extra_ctes]
    return "WITH " + ",".join(ctes) + "\n" + body


# SQL snippets mirroring functions.metrics
def dsum(col: str, cond: str | None = None) -> str:
    inner = f"CASE WHEN {cond} THEN {col} END" if cond else col
    return f"coalesce(sum({inner}), 0)"


def gpct(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100 ELSE 0.0 END"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


TY = "YearLabel = 'This Year'"
LY = "YearLabel = 'Last Year'"
