"""Explicit schemas of the vendor files, so no read has to infer them."""

PLAYER_POINT = "struct<jerseyNum: string, x: double, y: double, visibility: string, speed: double>"
BALL = "struct<x: double, y: double, visibility: string>"
GAME_EVENT = (
    "struct<game_event_type: string, home_ball: string, sequence: double, team_id: bigint, player_id: bigint, "
    "start_frame: bigint, end_frame: bigint>"
)
TRACKING = (
    "frameNum bigint, period int, videoTimeMs double, video_time_s double, videoTime double, periodGameClockTime double, "
    f"periodElapsedTime double, homePlayers array<{PLAYER_POINT}>, awayPlayers array<{PLAYER_POINT}>, "
    f"homePlayersSmoothed array<{PLAYER_POINT}>, awayPlayersSmoothed array<{PLAYER_POINT}>, balls array<{BALL}>, "
    f"ballsSmoothed {BALL}, game_event_id bigint, game_event {GAME_EVENT}"
)
FRAME_PLAYER = "struct<playerId: bigint, x: double, y: double, positionGroupType: string>"
EVENTS = (
    "gameEventId bigint, eventTime string, startTime string, endTime string, duration string, sequence string, "
    "gameEvents struct<gameEventType: string, period: string, playerId: string, playerName: string, teamId: string, teamName: string, "
    "homeTeam: boolean, startGameClock: double, startFormattedGameClock: string, setpieceType: string>, "
    "possessionEvents struct<possessionEventType: string, passOutcomeType: string, passerPlayerId: string, receiverPlayerId: string, "
    "targetPlayerId: string, shooterPlayerId: string, shooterPlayerName: string, shotType: string, bodyType: string, pressureType: string, "
    "shotOutcomeType: string, gameClock: double, formattedGameClock: string>, "
    "stadiumMetadata struct<teamAttackingDirection: string>, ball string, "
    f"homePlayers array<{FRAME_PLAYER}>, awayPlayers array<{FRAME_PLAYER}>"
)
EVENT_BALL = "array<struct<x: string, y: string>>"  # also reads a single object
PERSON = "struct<id: string, nickname: string, name: string>"
ROSTER_RECORD = f"player {PERSON}, team struct<id: string, name: string>, positionGroupType string, shirtNumber string"
ROSTER_ROW = f"struct<player: {PERSON}, team: struct<id: string, name: string>, positionGroupType: string, shirtNumber: string>"
ROSTER = f"{ROSTER_RECORD}, players array<{ROSTER_ROW}>, roster array<{ROSTER_ROW}>"
METADATA = "homeTeam struct<id: string>"
METADATA_LIST = "array<struct<homeTeam: struct<id: string>>>"  # also reads a single object
PROFILE = "level string, `group` string, minute int, metric string, mean double, sd double, n bigint"
