"""Dimension tables: the canonical fields, the keys of five tag systems, genres, and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYSTEMS = ("ID3v2", "VorbisComment", "MP4", "APEv2", "ASF")
PREFIX = {"ID3v2": "id3", "VorbisComment": "vorbis", "MP4": "mp4", "APEv2": "ape", "ASF": "asf"}

# Canonical field names and the keys by which each tag system writes them.
FIELDS = [
    "Title", "Artist", "Album", "AlbumArtist", "TrackNumber", "TotalTracks", "DiscNumber", "TotalDiscs", "Date", "Year", "Genre", "Comment", "Description", "Composer", "Performer", "Conductor",
    "Lyricist", "Publisher", "Copyright", "EncodedBy", "Encoder", "Language", "Mood", "BPM", "ISRC", "Barcode", "CatalogNumber", "Label", "Compilation", "Lyrics", "Work", "Movement", "MovementCount",
    "MovementIndex", "SortTitle", "SortArtist", "SortAlbum", "SortAlbumArtist", "SortComposer", "ReplayGainTrackGain", "ReplayGainTrackPeak", "ReplayGainAlbumGain", "ReplayGainAlbumPeak",
    "MusicBrainzTrackId", "MusicBrainzAlbumId", "MusicBrainzArtistId", "MusicBrainzReleaseGroupId", "AcoustIdFingerprint", "AcoustIdId",
]
ID3 = {
    "Title": "TIT2", "Artist": "TPE1", "Album": "TALB", "AlbumArtist": "TPE2", "TrackNumber": "TRCK", "DiscNumber": "TPOS", "Date": "TDRC", "Year": "TYER", "Genre": "TCON", "Comment": "COMM", "Composer": "TCOM", "Conductor": "TPE3", "Lyricist": "TEXT", "Publisher": "TPUB", "Copyright": "TCOP", "EncodedBy": "TENC", "Encoder": "TSSE", "Language": "TLAN", "Mood": "TMOO", "BPM": "TBPM", "ISRC": "TSRC", "Compilation": "TCMP", "Lyrics": "USLT", "SortTitle": "TSOT", "SortArtist": "TSOP", "SortAlbum": "TSOA", "SortAlbumArtist": "TSO2", "SortComposer": "TSOC",
    "Description": "TXXX:Description", "Performer": "TXXX:PERFORMER", "Barcode": "TXXX:BARCODE", "CatalogNumber": "TXXX:Catalog Number", "Label": "TXXX:LABEL", "ReplayGainTrackGain": "TXXX:REPLAYGAIN_TRACK_GAIN", "ReplayGainTrackPeak": "TXXX:REPLAYGAIN_TRACK_PEAK", "ReplayGainAlbumGain": "TXXX:REPLAYGAIN_ALBUM_GAIN", "ReplayGainAlbumPeak": "TXXX:REPLAYGAIN_ALBUM_PEAK", "MusicBrainzTrackId": "TXXX:MusicBrainz Track Id", "MusicBrainzAlbumId": "TXXX:MusicBrainz Album Id", "MusicBrainzArtistId": "TXXX:MusicBrainz Artist Id", "MusicBrainzReleaseGroupId": "TXXX:MusicBrainz Release Group Id", "AcoustIdFingerprint": "TXXX:Acoustid Fingerprint", "AcoustIdId": "TXXX:Acoustid Id",
}
VORBIS = {
    "Title": "TITLE", "Artist": "ARTIST", "Album": "ALBUM", "AlbumArtist": "ALBUMARTIST", "TrackNumber": "TRACKNUMBER", "TotalTracks": "TRACKTOTAL", "DiscNumber": "DISCNUMBER", "TotalDiscs": "DISCTOTAL", "Date": "DATE", "Year": "YEAR", "Genre": "GENRE", "Comment": "COMMENT", "Description": "DESCRIPTION", "Composer": "COMPOSER", "Performer": "PERFORMER", "Conductor": "CONDUCTOR", "Lyricist": "LYRICIST", "Publisher": "ORGANIZATION", "Copyright": "COPYRIGHT", "EncodedBy": "ENCODED-BY", "Encoder": "ENCODER", "Language": "LANGUAGE", "Mood": "MOOD", "BPM": "BPM", "ISRC": "ISRC", "Barcode": "UPC", "CatalogNumber": "CATALOGNUMBER", "Label": "LABEL", "Compilation": "COMPILATION", "Lyrics": "LYRICS", "Work": "WORK", "Movement": "MOVEMENTNAME", "MovementCount": "MOVEMENTCOUNT", "MovementIndex": "MOVEMENTNUMBER",
    "ReplayGainTrackGain": "REPLAYGAIN_TRACK_GAIN", "ReplayGainTrackPeak": "REPLAYGAIN_TRACK_PEAK", "ReplayGainAlbumGain": "REPLAYGAIN_ALBUM_GAIN", "ReplayGainAlbumPeak": "REPLAYGAIN_ALBUM_PEAK", "MusicBrainzTrackId": "MUSICBRAINZ_TRACKID", "MusicBrainzAlbumId": "MUSICBRAINZ_ALBUMID", "MusicBrainzArtistId": "MUSICBRAINZ_ARTISTID", "MusicBrainzReleaseGroupId": "MUSICBRAINZ_RELEASEGROUPID", "AcoustIdFingerprint": "ACOUSTID_FINGERPRINT", "AcoustIdId": "ACOUSTID_ID",
}
MP4 = {
    "Title": "©nam", "Artist": "©ART", "Album": "©alb", "AlbumArtist": "aART", "TrackNumber": "trkn", "DiscNumber": "disk", "Date": "©day", "Genre": "©gen", "Comment": "©cmt", "Description": "desc", "Composer": "©wrt", "Publisher": "©pub", "Copyright": "cprt", "Encoder": "©too", "BPM": "tmpo", "Compilation": "cpil", "Lyrics": "©lyr", "Work": "©wrk", "Movement": "©mvn", "MovementCount": "©mvc", "MovementIndex": "©mvi", "SortTitle": "sonm", "SortArtist": "soar", "SortAlbum": "soal", "SortAlbumArtist": "soaa", "SortComposer": "soco",
}
#: MP4 fields kept as free-form atoms, after the name space.
MP4_SPACE = "----:com.apple.itunes:"
MP4_FREE = {
    "Performer": "PERFORMER", "Conductor": "CONDUCTOR", "Lyricist": "LYRICIST", "EncodedBy": "ENCODED BY", "Language": "LANGUAGE", "Mood": "MOOD", "ISRC": "ISRC", "Barcode": "UPC", "CatalogNumber": "Catalog Number", "Label": "Label", "MusicBrainzTrackId": "MusicBrainz Track Id", "MusicBrainzAlbumId": "MusicBrainz Album Id", "MusicBrainzArtistId": "MusicBrainz Artist Id", "MusicBrainzReleaseGroupId": "MusicBrainz Release Group Id", "AcoustIdFingerprint": "Acoustid Fingerprint", "AcoustIdId": "Acoustid Id",
}
APE = {
    "Title": "Title", "Artist": "Artist", "Album": "Album", "AlbumArtist": "Album Artist", "TrackNumber": "Track", "DiscNumber": "Disc", "Date": "Year", "Genre": "Genre", "Comment": "Comment", "Description": "Description", "Composer": "Composer", "Conductor": "Conductor", "Publisher": "Publisher", "Copyright": "Copyright", "EncodedBy": "EncodedBy", "Encoder": "Encoder", "Language": "Language", "Mood": "Mood", "BPM": "BPM", "ISRC": "ISRC", "Barcode": "UPC", "CatalogNumber": "Catalog Number", "Label": "Label", "Compilation": "Compilation", "Lyrics": "Lyrics", "Work": "Work", "Movement": "Movement", "MovementCount": "Movement Count", "MovementIndex": "Movement Index", "SortTitle": "TITLESORTORDER", "SortArtist": "ARTISTSORTORDER", "SortAlbum": "ALBUMSORTORDER", "SortAlbumArtist": "ALBUMARTISTSORTORDER", "SortComposer": "COMPOSERSORTORDER",
    "ReplayGainTrackGain": "REPLAYGAIN_TRACK_GAIN", "ReplayGainTrackPeak": "REPLAYGAIN_TRACK_PEAK", "ReplayGainAlbumGain": "REPLAYGAIN_ALBUM_GAIN", "ReplayGainAlbumPeak": "REPLAYGAIN_ALBUM_PEAK", "MusicBrainzTrackId": "MUSICBRAINZ_TRACKID", "MusicBrainzAlbumId": "MUSICBRAINZ_ALBUMID", "MusicBrainzArtistId": "MUSICBRAINZ_ARTISTID", "MusicBrainzReleaseGroupId": "MUSICBRAINZ_RELEASEGROUPID", "AcoustIdFingerprint": "ACOUSTID_FINGERPRINT", "AcoustIdId": "ACOUSTID_ID",
}
ASF = {
    "Title": "Title", "Artist": "Author", "Album": "WM/AlbumTitle", "AlbumArtist": "WM/AlbumArtist", "TrackNumber": "WM/TrackNumber", "TotalTracks": "WM/TrackCount", "DiscNumber": "WM/PartOfSet", "TotalDiscs": "WM/DiscTotal", "Date": "WM/Year", "Genre": "WM/Genre", "Comment": "WM/Text", "Description": "Description", "Composer": "WM/Composer", "Performer": "WM/Performer", "Conductor": "WM/Conductor", "Publisher": "WM/Publisher", "Copyright": "Copyright", "EncodedBy": "WM/EncodedBy", "Encoder": "WM/EncodingSettings", "Language": "WM/Language", "Mood": "WM/Mood", "BPM": "WM/BeatsPerMinute", "ISRC": "WM/ISRC", "Barcode": "UPC", "CatalogNumber": "Catalog Number", "Label": "WM/Label", "Compilation": "WM/ContentGroupDescription", "Lyrics": "WM/Lyrics", "Work": "WM/Work", "SortTitle": "WM/TitleSortOrder", "SortArtist": "WM/ArtistSortOrder", "SortAlbum": "WM/AlbumSortOrder", "SortAlbumArtist": "WM/AlbumArtistSortOrder", "SortComposer": "WM/ComposerSortOrder",
    "ReplayGainTrackGain": "REPLAYGAIN_TRACK_GAIN", "ReplayGainTrackPeak": "REPLAYGAIN_TRACK_PEAK", "ReplayGainAlbumGain": "REPLAYGAIN_ALBUM_GAIN", "ReplayGainAlbumPeak": "REPLAYGAIN_ALBUM_PEAK",
}
#: Keys that are also read, as key to field.
ALIASES = {
    "ID3v2": {"TYER": "Date", "TDAT": "Date", "TXXX:UPC": "Barcode"},
    "VorbisComment": {"TOTALTRACKS": "TotalTracks", "TOTALDISCS": "TotalDiscs", "CATALOG NUMBER": "CatalogNumber", "BARCODE": "Barcode", "MOVEMENT": "Movement"},
    "MP4": {},
    "APEv2": {"albumartist": "AlbumArtist", "tracknumber": "TrackNumber", "totaltracks": "TotalTracks", "discnumber": "DiscNumber", "totaldiscs": "TotalDiscs", "date": "Date"},
    "ASF": {"comment": "Comment", "date": "Date", "isrc": "ISRC", "lyrics": "Lyrics"},
}
#: Frame ids that tell ID3v2 from other four-letter keys.
KNOWN_FRAMES = [
    "TIT2", "TALB", "TPE1", "TPE2", "TRCK", "TYER", "TDRC", "TCON", "COMM", "APIC", "TXXX", "TPOS", "TCOM", "TENC", "TBPM", "TLAN", "TPUB", "TSRC", "TCOP", "TEXT", "TDRL", "USLT", "WOAR", "WXXX",
]
#: The tag system of each format; formats that are not here are told by their keys.
FORMAT_SYSTEM = {
    "MP3": "ID3v2", "AIFF": "ID3v2", "WAVE": "ID3v2", "DSF": "ID3v2", "DSDIFF": "ID3v2", "ID3": "ID3v2", "EasyMP3": "ID3v2", "FLAC": "VorbisComment", "OggVorbis": "VorbisComment",
    "OggFlac": "VorbisComment", "OggOpus": "VorbisComment", "OggSpeex": "VorbisComment", "OggTheora": "VorbisComment", "MP4": "MP4", "M4A": "MP4", "MonkeysAudio": "APEv2", "WavPack": "APEv2",
    "Musepack": "APEv2", "TAK": "APEv2", "OptimFROG": "APEv2", "APEv2": "APEv2", "ASF": "ASF",
}
# Genre names by number, from 0.
GENRES = [
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae", "Rock", "Techno", "Industrial",
    "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance", "Classical", "Instrumental", "Acid", "House", "Game",
    "Sound Clip", "Gospel", "Noise", "Alt. Rock", "Bass", "Soul", "Punk", "Space", "Meditative", "Instrumental Pop", "Instrumental Rock", "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic",
    "Pop-Folk", "Eurodance", "Dream", "Southern Rock", "Comedy", "Cult", "Gangsta Rap", "Top 40", "Christian Rap", "Pop/Funk", "Jungle", "Native American", "Cabaret", "New Wave", "Psychedelic", "Rave",
    "Showtunes", "Trailer", "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock", "Folk", "Folk-Rock", "National Folk", "Swing", "Fast-Fusion", "Bebop",
    "Latin", "Revival", "Celtic", "Bluegrass", "Avantgarde", "Gothic Rock", "Progressive Rock", "Psychedelic Rock", "Symphonic Rock", "Slow Rock", "Big Band", "Chorus", "Easy Listening", "Acoustic",
    "Humour", "Speech", "Chanson", "Opera", "Chamber Music", "Sonata", "Symphony", "Booty Bass", "Primus", "Porn Groove", "Satire", "Slow Jam", "Club", "Tango", "Samba", "Folklore", "Ballad",
    "Power Ballad", "Rhythmic Soul", "Freestyle", "Duet", "Punk Rock", "Drum Solo", "A Cappella", "Euro-House", "Dance Hall", "Goa", "Drum & Bass", "Club-House", "Hardcore", "Terror", "Indie", "BritPop",
    "Afro-Punk", "Polsk Punk", "Beat", "Christian Gangsta Rap", "Heavy Metal", "Black Metal", "Crossover", "Contemporary Christian", "Christian Rock", "Merengue", "Salsa", "Thrash Metal", "Anime", "JPop",
    "Synthpop", "Abstract", "Art Rock", "Baroque", "Bhangra", "Big Beat", "Breakbeat", "Chillout", "Downtempo", "Dub", "EBM", "Eclectic", "Electro", "Electroclash", "Emo", "Experimental", "Garage",
    "Global", "IDM", "Illbient", "Industro-Goth", "Jam Band", "Krautrock", "Leftfield", "Lounge", "Math Rock", "New Romantic", "Nu-Breakz", "Post-Punk", "Post-Rock", "Psytrance", "Shoegaze", "Space Rock",
    "Trop Rock", "World Music", "Neoclassical", "Audiobook", "Audio Theatre", "Neue Deutsche Welle", "Podcast", "Indie Rock", "G-Funk", "Dubstep", "Garage Rock", "Psybient",
]


def write_keys(system: str) -> dict[str, str]:
    """Field to key, as the system writes it."""
    return {"ID3v2": ID3, "VorbisComment": VORBIS, "MP4": MP4 | {f: MP4_SPACE + k for f, k in MP4_FREE.items()}, "APEv2": APE, "ASF": ASF}[system]


def read_keys(system: str) -> list[tuple[str, str]]:
    """(key in the system's normal form, field). Keys of a system's own table come before its aliases."""
    fold = {"ID3v2": _fold_id3, "VorbisComment": str.upper, "MP4": _fold_mp4, "APEv2": str.lower, "ASF": str.lower}[system]
    own = {fold(k): f for f, k in write_keys(system).items() if (system, f) != ("ID3v2", "Year")}
    return list(({fold(k): f for k, f in ALIASES[system].items()} | own).items())


def _fold_id3(key: str) -> str:
    return "TXXX:" + key[5:].lower() if key.startswith("TXXX:") else key


def _fold_mp4(key: str) -> str:
    return key.lower() if key.startswith("----:") else key


def read_map(spark: SparkSession) -> DataFrame:
    """(system, norm_key, field): under 250 rows, so broadcasting it is safe."""
    return spark.createDataFrame([(s, k, f) for s in SYSTEMS for k, f in read_keys(s)], "system string, norm_key string, field string")


def write_map(spark: SparkSession) -> DataFrame:
    """(system, field, key): under 250 rows, so broadcasting it is safe."""
    return spark.createDataFrame([(s, f, k) for s in SYSTEMS for f, k in write_keys(s).items()], "system string, field string, key string")


# Friendly keys of ID3 files and the frames they stand for; date falls back to TYER and TDAT.
EASY_ID3 = {
    "album": "TALB", "albumartist": "TPE2", "albumartistsort": "TSO2", "albumsort": "TSOA", "arranger": "TPE4", "artist": "TPE1", "artistsort": "TSOP", "author": "TOLY", "bpm": "TBPM", "composer": "TCOM",
    "composersort": "TSOC", "conductor": "TPE3", "copyright": "TCOP", "date": "TDRC", "discnumber": "TPOS", "discsubtitle": "TSST", "encodedby": "TENC", "encodersettings": "TSSE", "fileowner": "TOWN",
    "genre": "TCON", "grouping": "TIT1", "isrc": "TSRC", "language": "TLAN", "length": "TLEN", "lyricist": "TEXT", "media": "TMED", "mood": "TMOO", "organization": "TPUB", "originalalbum": "TOAL",
    "originalartist": "TOPE", "originaldate": "TDOR", "title": "TIT2", "titlesort": "TSOT", "compilation": "TCMP", "tracknumber": "TRCK", "version": "TIT3", "comment": "COMM", "website": "WOAR",
    "acoustid_fingerprint": "TXXX:Acoustid Fingerprint", "acoustid_id": "TXXX:Acoustid Id", "musicbrainz_albumartistid": "TXXX:MusicBrainz Album Artist Id",
    "musicbrainz_albumid": "TXXX:MusicBrainz Album Id", "musicbrainz_albumstatus": "TXXX:MusicBrainz Album Status", "musicbrainz_albumtype": "TXXX:MusicBrainz Album Type",
    "musicbrainz_artistid": "TXXX:MusicBrainz Artist Id", "musicbrainz_discid": "TXXX:MusicBrainz Disc Id", "musicbrainz_releasegroupid": "TXXX:MusicBrainz Release Group Id",
    "musicbrainz_releasetrackid": "TXXX:MusicBrainz Release Track Id", "musicbrainz_trmid": "TXXX:MusicBrainz TRM Id", "musicbrainz_workid": "TXXX:MusicBrainz Work Id",
    "musicip_fingerprint": "TXXX:MusicMagic Fingerprint", "musicip_puid": "TXXX:MusicIP PUID", "releasecountry": "TXXX:MusicBrainz Album Release Country", "asin": "TXXX:ASIN", "barcode": "TXXX:BARCODE",
    "catalognumber": "TXXX:CATALOGNUMBER", "performer": "TXXX:PERFORMER",
}
# Friendly keys of MP4 files.
EASY_MP4 = {
    "title": "©nam", "album": "©alb", "artist": "©ART", "albumartist": "aART", "date": "©day", "comment": "©cmt", "description": "desc", "grouping": "©grp", "genre": "©gen", "composer": "©wrt",
    "copyright": "cprt", "albumsort": "soal", "albumartistsort": "soaa", "artistsort": "soar", "titlesort": "sonm", "composersort": "soco", "bpm": "tmpo", "compilation": "cpil", "tracknumber": "trkn",
    "discnumber": "disk", "encodingsoftware": "©too", "musicbrainz_artistid": "----:com.apple.iTunes:MusicBrainz Artist Id", "musicbrainz_trackid": "----:com.apple.iTunes:MusicBrainz Track Id",
    "musicbrainz_albumid": "----:com.apple.iTunes:MusicBrainz Album Id", "musicbrainz_albumartistid": "----:com.apple.iTunes:MusicBrainz Album Artist Id",
    "musicip_puid": "----:com.apple.iTunes:MusicIP PUID", "musicbrainz_albumstatus": "----:com.apple.iTunes:MusicBrainz Album Status",
    "musicbrainz_albumtype": "----:com.apple.iTunes:MusicBrainz Album Type", "releasecountry": "----:com.apple.iTunes:MusicBrainz Release Country",
}
