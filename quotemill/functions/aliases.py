"""Curated spellings: configuration, passed to the resolvers as plain mappings.

Fixed values: providers' spellings and the canonical names they stand for.
"""

TEAM_ALIASES = {
    "Man Utd": "Manchester United",
    "Man. United": "Manchester United",
    "Liverpool FC": "Liverpool",
    "Liv": "Liverpool",
    "FCB": "Barcelona",
    "Barca": "Barcelona",
    "Real Madrid CF": "Real Madrid",
    "Arsenal FC": "Arsenal",
    "Lille OSC": "Lille",
    "Brentford FC": "Brentford",
    "Sabah Masazir": "Sabah",
    "Galatasaray Istanbul": "Galatasaray",
    "Inter Milano": "Inter",
    "Viking FK": "Viking",
    "Fenerbahce Istanbul": "Fenerbahce",
    "PSG": "Paris Saint-Germain",
    "VfB Stuttgart": "Stuttgart",
    "CSD Xelaju MC": "Xelajú",
    "MS Tira": "Tira",
    "Ironi Baka El Garbiya": "Baqa Al-Gharbiyye",
    "Independiente Santa Fe": "Santa Fe",
    "Aguilas Doradas Rionegro": "Águilas Doradas",
    "Turks&Caicos Islands": "Turks and Caicos Islands",
    "Saint Martin": "Saint-Martin",
    "Antigva & Barbuda": "Antigua and Barbuda",
    "Atletico Fenix": "CA Fenix Montevideo",
    "Colon FC": "Colon Montevideo",
    "CS Cerrito": "Cerrito",
    "MS Ashdod": "Ashdod",
    "MS Football Hapoel Kiryat Yam": "Kiryat Yam",
    "Guadalupe": "Guadeloupe",
    "Republic Of Ireland": "Ireland",
    "Rep. Of Ireland": "Ireland",
    "Republic Ireland M21": "Ireland U21",
    "Northern Ireland M21": "Northern Ireland U21",
    "Atletico Madrid 2": "Atletico Madrid B",
    "Vancouver Whitecaps FC": "Vancouver Whitecaps",
    "Inter Toronto": "Inter Toronto FC",
    "Coban Imperial": "CSD Coban Imperial",
    "Brighton & Hove Albion": "Brighton and Hove Albion",
    "Charlotte FC": "Charlotte",
    "San Diego FC": "San Diego",
    "Bosnia-Herzegovina": "Bosnia and Herzegovina",
    "Everton": "Everton FC",
    "Toronto": "Toronto FC",
    "Fulham FC": "Fulham",
    "Philadelphia": "Philadelphia Union",
    "Austin FC": "Austin",
    "Dallas": "FC Dallas",
    "Saint Louis City SC": "St. Louis City",
    "Columbus": "Columbus Crew",
    "Ipswich": "Ipswich Town",
    "Chicago": "Chicago Fire",
    "Newcastle": "Newcastle United",
    "Colorado": "Colorado Rapids",
    "Tottenham": "Tottenham Hotspur",
    "Como": "Como 1907",
    "NY City": "New York City FC",
    "Leeds": "Leeds United",
    "Sunderland AFC": "Sunderland",
    "Chelsea": "Chelsea FC",
    "Feyenoord": "Feyenoord Rotterdam",
    "Bournemouth": "AFC Bournemouth",
    "Manchester City W": "Manchester City WFC (W)",
    "Manchester United W": "Manchester United WFC (W)",
    "West Ham W": "West Ham United FC (W)",
    "Real Madrid W": "Real Madrid (W)",
}

TOKEN_ALIASES = {
    "UAE": "United Arab Emirates",
    "USA": "United States",
}

LEAGUE_ALIASES = {
    "Azijske igre M23": "Azija - Azijske Igre U23",
    "EPL": "England - Premier League",
    "Premier Liga": "England - Premier League",
    "Engleska - Premier Liga": "England - Premier League",
    "Engleska 1": "England - Premier League",
    "Italija 1": "Italy - Serie A",
    "Italija - Serija A": "Italy - Serie A",
    "MLS Liga": "USA - Major League Soccer",
    "SAD - MLS Liga": "USA - Major League Soccer",
    "SAD - MLS": "USA - Major League Soccer",
    "Major League Soccer": "USA - Major League Soccer",
    "Liga Nacija": "UEFA Nations League",
    "Liga nacija (A) - Evropa": "UEFA Nations League",
    "Liga nacija (B) - Evropa": "UEFA Nations League",
    "Liga nacija (C) - Evropa": "UEFA Nations League",
    "Liga nacija (D) - Evropa": "UEFA Nations League",
    "Evropa - Liga Šampiona": "Liga Šampiona",
    "Engleska - EFL Kup": "EFL Kup",
    "Engleska Liga Kup W": "WSL Cup",
    "FA Ženska Superliga": "Engleska - FA Ženska Superliga",
    "Engleska 1 W": "Engleska - FA Ženska Superliga",
    "Liga šampiona W": "Evropa - Liga Šampiona Žene",
}
