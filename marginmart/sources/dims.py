"""Dimension tables for the lookups of the enrichment (sport, team, marketplace tier).

They are tiny and fixed (3, 127 and 10 rows), so joining them with ``broadcast`` is safe
at any fact size: their size does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the source application's lookup tables so
# lookups give the same answers.  Kept as plain data, in their natural order.
# ---------------------------------------------------------------------------

# Requested performer type id -> sport.
SPORT_BY_TYPE_ID = {
    38: "NBA",
    42: "NFL",
    43: "NHL",
}

# Team -> state / province, per league.
NBA_TEAMS = {
    "Atlanta Hawks": "GA", "Boston Celtics": "MA", "Brooklyn Nets": "NY",
    "Charlotte Hornets": "NC", "Chicago Bulls": "IL", "Cleveland Cavaliers": "OH",
    "Dallas Mavericks": "TX", "Denver Nuggets": "CO", "Detroit Pistons": "MI",
    "Golden State Warriors": "CA", "Houston Rockets": "TX", "Indiana Pacers": "IN",
    "Los Angeles Clippers": "CA", "Los Angeles Lakers": "CA", "LA Clippers": "CA",
    "Memphis Grizzlies": "TN", "Miami Heat": "FL", "Milwaukee Bucks": "WI",
    "Minnesota Timberwolves": "MN", "New Orleans Pelicans": "LA",
    "New York Knicks": "NY", "Oklahoma City Thunder": "OK", "Orlando Magic": "FL",
    "Philadelphia 76ers": "PA", "Phoenix Suns": "AZ", "Portland Trail Blazers": "OR",
    "Sacramento Kings": "CA", "San Antonio Spurs": "TX", "Toronto Raptors": "ON",
    "Utah Jazz": "UT", "Washington Wizards": "DC",
}
NFL_TEAMS = {
    "Arizona Cardinals": "AZ", "Atlanta Falcons": "GA", "Baltimore Ravens": "MD",
    "Buffalo Bills": "NY", "Carolina Panthers": "NC", "Chicago Bears": "IL",
    "Cincinnati Bengals": "OH", "Cleveland Browns": "OH", "Dallas Cowboys": "TX",
    "Denver Broncos": "CO", "Detroit Lions": "MI", "Green Bay Packers": "WI",
    "Houston Texans": "TX", "Indianapolis Colts": "IN", "Jacksonville Jaguars": "FL",
    "Kansas City Chiefs": "MO", "Las Vegas Raiders": "NV",
    "Los Angeles Chargers": "CA", "Los Angeles Rams": "CA", "Miami Dolphins": "FL",
    "Minnesota Vikings": "MN", "New England Patriots": "MA", "New Orleans Saints": "LA",
    "New York Giants": "NJ", "New York Jets": "NJ", "Philadelphia Eagles": "PA",
    "Pittsburgh Steelers": "PA", "San Francisco 49ers": "CA", "Seattle Seahawks": "WA",
    "Tampa Bay Buccaneers": "FL", "Tennessee Titans": "TN", "Washington Commanders": "DC",
}
NHL_TEAMS = {
    "Anaheim Ducks": "CA", "Boston Bruins": "MA", "Buffalo Sabres": "NY",
    "Calgary Flames": "AB", "Carolina Hurricanes": "NC", "Chicago Blackhawks": "IL",
    "Colorado Avalanche": "CO", "Columbus Blue Jackets": "OH", "Dallas Stars": "TX",
    "Detroit Red Wings": "MI", "Edmonton Oilers": "AB", "Florida Panthers": "FL",
    "Los Angeles Kings": "CA", "Minnesota Wild": "MN", "Montreal Canadiens": "QC",
    "Nashville Predators": "TN", "New Jersey Devils": "NJ", "New York Islanders": "NY",
    "New York Rangers": "NY", "Ottawa Senators": "ON", "Philadelphia Flyers": "PA",
    "Pittsburgh Penguins": "PA", "San Jose Sharks": "CA", "Seattle Kraken": "WA",
    "St. Louis Blues": "MO", "Tampa Bay Lightning": "FL", "Toronto Maple Leafs": "ON",
    "Utah Hockey Club": "UT", "Utah Mammoth": "UT", "Vancouver Canucks": "BC",
    "Vegas Golden Knights": "NV", "Washington Capitals": "DC", "Winnipeg Jets": "MB",
}
MLB_TEAMS = {
    "Arizona Diamondbacks": "AZ", "Atlanta Braves": "GA", "Baltimore Orioles": "MD",
    "Boston Red Sox": "MA", "Chicago Cubs": "IL", "Chicago White Sox": "IL",
    "Cincinnati Reds": "OH", "Cleveland Guardians": "OH", "Colorado Rockies": "CO",
    "Detroit Tigers": "MI", "Houston Astros": "TX", "Kansas City Royals": "MO",
    "Los Angeles Angels": "CA", "Los Angeles Dodgers": "CA", "Miami Marlins": "FL",
    "Milwaukee Brewers": "WI", "Minnesota Twins": "MN", "New York Mets": "NY",
    "New York Yankees": "NY", "Athletics": "CA", "Oakland Athletics": "CA",
    "Philadelphia Phillies": "PA", "Pittsburgh Pirates": "PA", "San Diego Padres": "CA",
    "San Francisco Giants": "CA", "Seattle Mariners": "WA",
    "St. Louis Cardinals": "MO", "Tampa Bay Rays": "FL", "Texas Rangers": "TX",
    "Toronto Blue Jays": "ON", "Washington Nationals": "DC",
}

# Marketplace (ShippingCompany) -> channel tier; anything else is 'Other'.
MARKETPLACE_TIER = {
    "StubHub": "Tier 1 - Major",
    "SeatGeek": "Tier 1 - Major",
    "Vivid Seats": "Tier 1 - Major",
    "Vivid": "Tier 1 - Major",
    "TickPick": "Tier 2 - Mid",
    "Gametime": "Tier 2 - Mid",
    "TicketsNow": "Tier 2 - Mid",
    "Ticket Evolution": "Tier 3 - B2B",
    "GoTickets": "Tier 3 - B2B",
    "Expired": "Expired/Other",
}

# Every sport label the enrichment can produce (lookups plus the fallback).
SPORTS = ["MLB", "NBA", "NFL", "NHL", "Other"]
# ---------------------------------------------------------------------------

LEAGUES = (("NBA", NBA_TEAMS), ("NFL", NFL_TEAMS), ("NHL", NHL_TEAMS), ("MLB", MLB_TEAMS))


def team_rows() -> list[tuple[str, str, str]]:
    """(team, sport, state) rows; the later league wins on a repeated name."""
    merged: dict[str, tuple[str, str]] = {}
    for sport, teams in LEAGUES:
        for team, state in teams.items():
            merged[team] = (sport, state)
    return [(team, sport, state) for team, (sport, state) in merged.items()]


def _values(spark: SparkSession, rows, columns: str) -> DataFrame:
    """An inline relation: no Python job, and Spark knows its size."""
    return spark.sql("select * from values " + ", ".join(str(tuple(r)) for r in rows) + f" as t({columns})")


def sport_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, SPORT_BY_TYPE_ID.items(), "type_id, type_sport")


def team_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, team_rows(), "team, team_sport, team_state")


def marketplace_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, MARKETPLACE_TIER.items(), "marketplace, tier")
